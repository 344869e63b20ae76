"""Speech transcripts into clean, ordered speaker turns.

Each transcript is parsed into segments (time, label, words) by its layout. Clocks that start again
split the file into file segments, which are shifted to follow each other; within each, times that
cannot be right take the value of the isotonic regression of the others over the file's order.
Segments are then put in order of time, labels are resolved to participants, utterances are cleaned,
and neighbouring segments of one speaker become one turn.
"""

from __future__ import annotations

import itertools
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEECH_TYPES = ("audio", "video", "youtube")
RESET_SECONDS = 300.0
OFF_SECONDS = 900.0
LABEL_LENGTH = 64

_TIME = r"(?:\d+:)?\d{1,2}:\d\d(?:[.,]\d{1,3})?"
LEADING_TIME = re.compile(rf"^\s*[\[(]\s*({_TIME})\s*[\])]\s*")
LABEL_TIME = re.compile(rf"^\s*([^()\[\]:]{{1,48}}?)\s*[\[(]\s*({_TIME})\s*[\])]\s*(?::|>|-(?=\s))\s?(.*)$")
BLOCK_HEAD = re.compile(rf"^\s*(\S.{{0,47}}?)(?: {{2,}}|\t)[\[(]?({_TIME})[\])]?\s*$")
CUE = re.compile(rf"^\s*({_TIME})\s*-->\s*{_TIME}")
SEPARATOR = re.compile(r"\s*(?::|>|\s-)(?=\s|$)")
VOICE = re.compile(r"^\s*<v(?:\.[\w.]*)?\s+([^>]*)>(.*?)(?:</v>)?\s*$", re.S)
TIME_MARK = re.compile(rf"[\[(<{{]\s*{_TIME}\s*[\])>}}]")
NOTE = re.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*\n]{1,60}\*|♪[^♪]*♪?|[♪♫]")
ROUND = re.compile(r"\(([^()]{1,60})\)")
# Stems that make a remark in round brackets a sound or transcriber's note.
SOUND = re.compile(
    r"\b(laugh|chuckl|giggl|applau|clap|cheer|cough|sigh|sneez|sniff|breath|inhal|exhal|gasp|groan|yawn|whisper|mumbl|music|singing|hums?\b|humming|"
    r"nois|static|beep|rings?\b|ringing|phone|door|knock|footstep|silen|paus|inaudib|unintelligib|indistinct|crosstalk|cross talk|"
    r"overlap|throat|background|crowd|slam|bells?\b|typing)",
    re.I,
)
# Hesitation and listening sounds, and phrases that add nothing.
FILLER = re.compile(
    r"(?<![\w'’-])(?:mm+-?hm+|m-?hm+|uh-?huh|u+h+m*|u+m+|e+r+m*|e+h+m*|a+h+m*|h+m+|m{2,})(?![\w'’]|-\w)",
    re.I,
)
STOCK = r"(?:you know|i mean|sort of|kind of|like)"
BETWEEN = re.compile(rf"(?:(?<=,)|(?<=[.?!…:;])|^)[\s\"'“”]*{STOCK}\s*(?=,)", re.I)
OPENING = re.compile(r"(?<![\w'’])(?:You know|I mean|Sort of|Kind of|Like)\s*(?=,)")


@dataclass
class Segment:
    time: float | None
    label: str | None
    text: str


def seconds(stamp: str) -> float:
    value = 0.0
    for part in stamp.replace(",", ".").split(":"):
        value = value * 60 + float(part)
    return value


def isotonic(values: list[float]) -> list[float]:
    """Least-squares non-decreasing fit (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v in values:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            n = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n])
    return [m for m, n in pools for _ in range(int(n))]


def in_order(times: list[float]) -> list[int]:
    """Places of a longest non-decreasing subsequence."""
    ends: list[float] = []
    at: list[int] = []
    before = [-1] * len(times)
    for k, t in enumerate(times):
        j = bisect_right(ends, t)
        before[k] = at[j - 1] if j else -1
        ends[j : j + 1], at[j : j + 1] = [t], [k]
    k = at[-1] if at else -1
    found = []
    while k >= 0:
        found.append(k)
        k = before[k]
    return found[::-1]


def _step(times: list[float]) -> float:
    """A usual step of a clock: the median of its steps."""
    steps = sorted(b - a for a, b in itertools.pairwise(times))
    return steps[len(steps) // 2] if steps else 0.0


def _starts_again(times: list[float], start: int, i: int) -> bool:
    """Whether a short file ends before ``i``: the clock falls near its beginning, and goes on from there past where it was.

    The times around are in order as two files, but not as one (three of them at least would have to go), and
    they pass the old clock by no more than its usual steps, as a block moved within one file doesn't. Where
    lines near the place stand in another order anyway, nothing is told.
    """
    left, right = times[max(start, i - 40) : i], times[i : i + 40]
    top = max(left)
    if times[i] >= 0.2 * top or times[i] > max(30.0, times[start]) or min(right) < times[i]:
        return False
    lost = [len(x) - len(in_order(x)) for x in (left + right, left, right)]
    if lost[0] - lost[1] - lost[2] < 3 or sorted(left[-8:]) != left[-8:] or sorted(right[:8]) != right[:8]:
        return False
    usual = 10 * max(_step([left[k] for k in in_order(left)]), _step([right[k] for k in in_order(right)]))
    return all(b - a <= usual for a, b in itertools.pairwise(right) if a <= top < b)


def repair_clock(times: list[float], reset: float = RESET_SECONDS, off: float = OFF_SECONDS) -> list[float]:
    """Times on one clock, in the order of the file.

    The clock starts again where a time falls far below the latest ones (by ``reset`` seconds and to
    under a fifth of them) and none of the times after it comes back near, or where a short file
    ends; later times are shifted. Within a file segment, a time that can't be right takes the isotonic fit.
    """
    if not times:
        return []
    parts, start = [], 0
    top, second = times[0], times[0]
    for i in range(1, len(times)):
        near = max(times[i : i + 4])
        far = second - times[i] > reset and times[i] < 0.2 * second and near < 0.5 * second
        if far or times[i] < 0.2 * top and _starts_again(times, start, i):
            parts.append((start, i))
            start, top, second = i, times[i], times[i]
        elif times[i] > top:
            top, second = times[i], top if i > start + 1 else times[i]
        elif times[i] > second:
            second = times[i]
    parts.append((start, len(times)))
    out, shift = [], 0.0
    for a, b in parts:
        out += [t + shift for t in _without_strays(times[a:b], off)]
        shift = max(out[a:b])
    return out


def _without_strays(times: list[float], off: float) -> list[float]:
    """Times with those that can't be right as the isotonic regression of the others has it at their places.

    A time is a stray if it is further than ``off`` seconds from the times between which it stands, or if it
    lies beyond all the times in order by more than a minute and ten usual steps. Lines that only stand in
    another order keep their times.
    """
    kept = in_order(times)
    line = [times[k] for k in kept]
    near = max(60.0, 10 * _step(line))
    right = []
    for k, t in enumerate(times):
        j = bisect_left(kept, k)
        low, high = line[max(0, j - 1)] if j else line[0], line[min(j, len(line) - 1)]
        away = max(low - t, t - high, 0.0)
        if away <= off and not (away > near and (t > line[-1] + near or t < line[0] - near)):
            right.append(k)
    fit = isotonic([times[k] for k in right])
    out = list(times)
    for k in set(range(len(times))).difference(right):
        out[k] = fit[max(0, bisect_left(right, k) - 1)]
    return out


def _letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", s.lower())


def _within(a: str, b: str, most: int) -> int | None:
    """Edit distance of a and b if at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] if row[-1] <= most else None


class Speakers:
    """Resolves labels (full names, parts, initials, numbers, small misspellings) to participants."""

    def __init__(self, metadata: dict[str, str]):
        self.names = self._names(metadata.get("participants") or "")
        self.numbered: dict[int, str] = {}
        for part in re.split(r"[|;\n]", metadata.get("diarization") or ""):
            m = re.match(r"\s*\D*(\d+)\s*[=:]\s*(.+?)\s*$", part)
            if m:
                self.numbered[int(m.group(1))] = self._full(m.group(2))
        self.known: dict[str, str | None] = {}
        self.forms: list[tuple[str, str]] = []
        for name in self.names:
            words = name.split()
            first, last = words[0], words[-1]
            for form in {_letters(name), _letters(first + last), _letters(last + first), _letters(first[0] + last), _letters(first), _letters(last)}:
                self.forms.append((form, name))

    @staticmethod
    def _names(listed: str) -> list[str]:
        text = listed.strip()
        if text.startswith("["):
            try:
                parts = [str(x) for x in json.loads(text)]
            except ValueError:
                parts = re.split(r"[;,|]", text.strip("[]").replace('"', ""))
        else:
            parts = re.split(r"[;|\n]" if re.search(r"[;|\n]", text) else r",", text)
        clean = [" ".join(re.sub(r"\([^)]*\)", " ", p).split()) for p in parts]
        return list(dict.fromkeys(c for c in clean if c))

    def _full(self, name: str) -> str:
        name = " ".join(re.sub(r"\([^)]*\)", " ", name).split())
        return next((n for n in self.names if _letters(n) == _letters(name)), name)

    def resolve(self, label: str) -> str | None:
        label = label.strip(" \t>*-–—:")
        if label not in self.known:
            self.known[label] = self._resolve(label)
        return self.known[label]

    def _resolve(self, label: str) -> str | None:
        number = re.fullmatch(r"(?:speaker|spk|sprecher|s)[\s_#-]*(\d+)", label, re.I)
        if number:
            n = int(number.group(1))
            if n in self.numbered:
                return self.numbered[n]
            return self.names[n] if not self.numbered and n < len(self.names) else None
        label = re.sub(r"\([^)]*\)", " ", label).strip()
        key = _letters(label)
        if not key or len(label.split()) > 4 or re.search(r"\d", label):
            return None
        if re.fullmatch(r"[A-Z]\.?\s?[A-Z]\.?", label):
            same = [n for n in self.names if (n.split()[0][0] + n.split()[-1][0]).lower() == key]
            if same:
                return same[0]
        exact = list(dict.fromkeys(n for form, n in self.forms if form == key))
        if exact:
            return exact[0]
        if len(key) >= 4:
            near = [(d, -len(form), n) for form, n in self.forms for d in [_within(key, form, 2 if min(len(key), len(form)) >= 9 else 1)] if d is not None]
            if near:
                return min(near)[2]
        return None


def _split_label(line: str, speakers: Speakers) -> tuple[str | None, str]:
    """(speaker, rest) if the line begins with a label of a known speaker."""
    body = re.sub(r"^\s*>>+\s*", "", line)
    for m in SEPARATOR.finditer(body[:LABEL_LENGTH]):
        name = speakers.resolve(body[: m.start()]) if m.start() else None
        if name:
            return name, body[m.end() :]
    return None, line


def _cues(lines: list[str], speakers: Speakers) -> list[Segment]:
    out: list[Segment] = []
    time: float | None = None
    held: list[str] = []

    def close() -> None:
        text = "\n".join(held).strip()
        if time is not None and text:
            voice = VOICE.match(text)
            if voice:
                out.append(Segment(time, speakers.resolve(voice.group(1)), voice.group(2)))
            else:
                out.append(Segment(time, *_split_label(text, speakers)))

    for k, line in enumerate(lines):
        cue = CUE.match(line)
        if cue:
            close()
            time, held = seconds(cue.group(1)), []
        elif line.strip().isdigit() and any(CUE.match(x) for x in lines[k + 1 : k + 2]):
            continue
        elif time is not None:
            held.append(line)
    close()
    return out


def _blocks(lines: list[str], speakers: Speakers) -> list[Segment]:
    out: list[Segment] = []
    for line in lines:
        head = BLOCK_HEAD.match(line)
        name = speakers.resolve(head.group(1)) if head else None
        alone = re.match(rf"^\s*[\[(]?({_TIME})[\])]?\s*$", line)
        if head and name:
            out.append(Segment(seconds(head.group(2)), name, ""))
        elif alone:
            out.append(Segment(seconds(alone.group(1)), None, ""))
        elif line.strip():
            if not out:
                out.append(Segment(None, None, ""))
            out[-1].text += " " + line
    return out


def _lines(lines: list[str], speakers: Speakers) -> list[Segment]:
    full = [x for x in lines if x.strip()]
    leading = sum(bool(LEADING_TIME.match(x)) for x in full)
    labelled = sum(bool(LABEL_TIME.match(x)) for x in full)
    clock_first = leading >= max(labelled, 0.5 * len(full))
    out: list[Segment] = []
    for line in full:
        if clock_first and (m := LEADING_TIME.match(line)):
            out.append(Segment(seconds(m.group(1)), *_split_label(line[m.end() :], speakers)))
            continue
        m = None if clock_first else LABEL_TIME.match(line)
        if m and (name := speakers.resolve(re.sub(r"^\s*>>+", "", m.group(1)))):
            out.append(Segment(seconds(m.group(2)), name, m.group(3)))
            continue
        name, rest = _split_label(line, speakers)
        if name or not out:
            out.append(Segment(None, name, rest))
        else:
            out[-1].text += " \n" + rest
    return out


def parse(text: str, metadata: dict[str, str], speakers: Speakers) -> list[Segment]:
    lines = re.sub(r"\r\n?", "\n", text).replace("﻿", "").split("\n")
    layout = (metadata.get("layout") or "").lower()
    if layout in ("srt", "vtt") or (layout not in ("lines", "block") and any(CUE.match(x) for x in lines)):
        return _cues(lines, speakers)
    if layout == "block" or (layout != "lines" and sum(bool(BLOCK_HEAD.match(x)) for x in lines) >= 2):
        return _blocks(lines, speakers)
    return _lines(lines, speakers)


def clean_utterance(text: str) -> str:
    """An utterance without time marks, notes, hesitations and stock phrases."""
    text = TIME_MARK.sub(" ", text)
    text = NOTE.sub(" ", text)
    text = ROUND.sub(lambda m: " " if SOUND.search(m.group(1)) else m.group(0), text)
    parts = []
    for piece in text.split("\n"):
        piece = FILLER.sub(" ", piece)
        before = None
        while before != piece:
            before = piece
            piece = OPENING.sub(" ", BETWEEN.sub(" ", re.sub(r"\s+", " ", piece).strip()))
        parts.append(piece)
    text = re.sub(r"\s+", " ", " ".join(parts))
    text = re.sub(r"(?:\s*,)+(?=\s*[,.?!])|^[\s,.?!…;:-]+", "", text)
    return re.sub(r"\s+([,.?!])", r"\1", text).strip()


_NOT_WORDS = re.compile(r"[^a-z0-9']+")


def turns(text: str | None, metadata: dict[str, str] | None) -> list[tuple[int, str | None, str]]:
    """(turn_no, speaker, text) of one transcript."""
    if not text or not text.strip():
        return []
    metadata = metadata or {}
    speakers = Speakers(metadata)
    segments = parse(text, metadata, speakers)
    timed = [s for s in segments if s.time is not None]
    if len(timed) > 1:
        for s, t in zip(timed, repair_clock([s.time for s in timed])):
            s.time = t
        last, keyed = float("-inf"), []
        for k, s in enumerate(segments):
            last = s.time if s.time is not None else last
            keyed.append((last, k, s))
        segments = [s for _, _, s in sorted(keyed, key=lambda x: x[:2])]
    seen: set[tuple] = set()
    out: list[list] = []
    speaker = next((s.label for s in segments if s.label), None)
    for s in segments:
        speaker = s.label or speaker
        if s.time is not None:
            again = (s.time, _NOT_WORDS.sub(" ", s.text.lower()))
            if again in seen:
                continue
            seen.add(again)
        said = clean_utterance(s.text)
        if not _NOT_WORDS.sub("", said.lower()).strip("'"):
            continue
        if out and out[-1][0] == speaker:
            out[-1][1] += " " + said
        else:
            out.append([speaker, said])
    return [(k, who, what) for k, (who, what) in enumerate(out, 1)]


def latest_documents(raw: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(document_id, text, metadata): of repeated rows the one taken in last; null ids are left out."""
    rows = raw.where(F.col("document_id").isNotNull() & F.col("source_type").isin(*types)).select(
        "document_id",
        F.struct("ingested_at", "created_at", "text", F.to_json("metadata").alias("metadata")).alias("v"),
    )
    return rows.groupBy("document_id").agg(F.max("v").alias("v")).select("document_id", "v.text", "v.metadata")


def speaker_turns(raw: DataFrame, types: tuple[str, ...] = SPEECH_TYPES) -> DataFrame:
    """(document_id, turn_no, speaker, turn_text) for the transcripts among raw documents.

    Null, empty and blank texts have no turns; a transcript without metadata is parsed by its looks
    and unresolved speakers are null; repeated rows of a document count once; extra columns are ignored.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, *turn)
                for i, text, meta in zip(pdf["document_id"], pdf["text"], pdf["metadata"])
                for turn in turns(text, json.loads(meta) if meta else None)
            ]
            yield pd.DataFrame(rows, columns=["document_id", "turn_no", "speaker", "turn_text"])

    return latest_documents(raw, types).mapInPandas(read, "document_id string, turn_no int, speaker string, turn_text string")


def turn_md5(text: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9']+", " ")))
