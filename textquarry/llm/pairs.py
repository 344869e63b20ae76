"""Defects of instruction and response pairs: empty, truncated, refusal, copy, wrong_language.

A response that says nothing is empty. Refusals, also after thanks or a greeting, and languages are found with dictionaries. For copies,
the response is compressed with zstandard under its own prompt as dictionary: what is only repeated
costs next to nothing; an alignment of words then confirms that the instruction or the whole input
is repeated, not a part of it. Whether an unpunctuated end is an end is judged by a terminal-context
model: how often, over the whole corpus, the last two words are followed by the end of a sentence
or of a list item that others follow.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
COPY_RATIO = 0.55
COPY_SHARE = 0.75
END_SHARE = 0.5
MOST_ASKED = 500_000
FOREIGN_WORDS, FOREIGN_SHARE = 12, 0.06

# Words that stand for a missing answer, and labels that precede one.
NOTHING = {"none", "null", "nil", "nan", "na", "n a", "tbd", "tba", "todo", "undefined", "empty", "no answer", "no response", "not available",
           "keine antwort", "keine", "sans réponse", "pas de réponse", "aucune réponse", "sin respuesta", "no hay respuesta"}
LABELS = r"(?:answer|response|output|question|instruction|antwort|frage|ausgabe|réponse|question|respuesta|pregunta)"

LABEL_START = re.compile(rf"^\W*{LABELS}\s*:", re.I)

# Frequent words of each language that the others lack or seldom use.
FUNCTION_WORDS = {
    "en": "the of and to is was with that for by from it this what who which an are were had has have be been not only but most as until before after"
          " than about between into through when where how why there they their its on at nobody every without under however",
    "de": "der die das und ist war wurde wurden nicht für mit den dem des ein eine einer eines auf aus bei nach noch immer auch zum zur von vom im"
          " wenn wird sind sich wie was warum wer wo als oder aber kaum über unter obwohl solange niemand danach zuerst schon besonders so",
    "fr": "le la les des du une un et est était au aux dans pour sur avec que qui ne pas plus ce cette ces son sa ses il elle on nous vous mais ou où"
          " quand tant bien après encore très peu beaucoup personne selon d'abord puis été sont comme pourquoi quelle",
    "es": "el la los las del una un y es era en para sobre con que quien no más este esta estos su sus se lo al pero o donde cuando aunque después"
          " todavía muy pocos muchos nadie según primero luego ha han está como por qué ya mientras siendo sigue cuál",
}
_LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGES_OF: dict[str, tuple[int, ...]] = {
    w: tuple(k for k, lang in enumerate(_LANGUAGES) if w in FUNCTION_WORDS[lang].split()) for words in FUNCTION_WORDS.values() for w in words.split()
}
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|ingl[eé]s\w*",
    "de": r"german|deutsch\w*|allemand\w*|alem[aá]n\w*",
    "fr": r"french|französisch\w*|français\w*|franc[eé]s\w*",
    "es": r"spanish|spanisch\w*|espagnol\w*|español\w*|castellano",
}
_ANY_ASKED = re.compile("|".join(LANGUAGE_NAMES.values()), re.I)
_ASKED = {lang: re.compile(rf"\b(?:{names})\b", re.I) for lang, names in LANGUAGE_NAMES.items()}

# Ways to decline, in the first person or by rule, in lower case.
REFUSALS = re.compile(
    "|".join(
        (
            r"\bi(?:['’]m| am) (?:sorry|afraid)\b",
            r"\bi(?:['’]m| am) (?:not able|unable|not permitted|not allowed|not in a position)\b",
            r"\bi (?:can['’]?t|cannot|can not|won['’]?t|will not|could not|may not)(?: be able to)? (?:help|assist|answer|provide|comment|discuss|share|say|do|give|talk|respond|reply|fulfil|comply|support|offer|engage)",
            r"\bi (?:must|have to|need to|will have to|regretfully|respectfully) (?:decline|refuse|pass)\b|\bi (?:decline|refuse) to\b",
            r"\bi (?:do not|don['’]t|lack) (?:have )?(?:enough|sufficient|access|the information|any information)\b",
            r"\bas an? (?:ai|large language|language model|artificial|virtual|chat)",
            r"\bi(?:['’]d| would) (?:rather|prefer) not\b|\bi prefer not\b",
            r"\b(?:not be|not|isn['’]t|in)\s?appropriate for me\b",
            r"\bnothing i (?:am|can|may)\b|\bi am permitted\b|\bmy (?:guidelines|policy|policies|instructions|rules) (?:keep|prevent|forbid|do not|don['’]t)",
            r"\b(?:outside|beyond) what i (?:may|can|am)\b",
            r"\bgo unanswered\b|\bunanswered by me\b|\bno can do\b|\boff[- ]limits\b|\breply is not possible\b|\bregrettably\b",
            r"\bsorry, (?:but )?(?:that|this|i|no)\b|^\W*sorry\b|^\W*apologies\b|\bi apologi[sz]e\b",
            r"\blet(?:['’]s| us) (?:talk|speak|discuss|turn to|move on|switch|stick|focus)\b.*\b(?:something|anything|topics?|subjects?|matters?) (?:else|other|different)\b|\b(?:talk|speak) about (?:something|anything) (?:else|other)\b",
            r"\blet(?:['’]s| us) (?:change the (?:subject|topic)|(?:talk|speak) about another|not (?:talk|speak|go|discuss))\b|\b(?:pick|choose|try) (?:another|a different) (?:topic|subject)\b|\bno comment\b",
            r"\b(?:reden|sprechen) (?:wir|sie) (?:lieber )?(?:über|von) etwas ander(?:es|em)\b|\büber etwas anderes (?:reden|sprechen)\b|\bwechseln wir das thema\b",
            r"\bparlons (?:plutôt )?d['’]autre chose\b|\bchangeons de sujet\b|\bhablemos (?:mejor )?de otra cosa\b|\bcambiemos de tema\b",
            r"\bunfortunately,? i\b|\bunable to (?:help|assist|answer|provide|comply)\b",
            r"\btut mir leid\b|\bich bin nicht (?:in der lage|befugt|berechtigt)\b|\b(?:kann|darf|möchte|werde) ich (?:leider |dazu |hier )*(?:nicht|nichts|keine)\b",
            r"\bich (?:kann|darf|möchte|werde) (?:\w+ ){0,3}(?:nicht|nichts|keine)\b|\bals (?:sprachmodell|ki\b|ki-)|\bleider (?:kann|darf) ich\b|\bkeine auskunft\b|\bich lehne\b",
            r"\bje (?:suis )?désolée?\b|\bdésolée?,|\bje (?:ne|n['’]) ?(?:peux|puis|suis|ai|souhaite|dispose)\b|\bje préfère ne\b|\bje refuse\b|\bil m['’]est impossible\b|\ben tant que (?:modèle|ia)\b|\bje regrette\b|\bmalheureusement,? je\b",
            r"\blo siento\b|\bno (?:puedo|podré|debo|me es posible|tengo (?:acceso|suficiente|permitido)|estoy (?:autorizad|en condiciones))|\bprefiero no\b|\bcomo modelo\b|\blamento\b|\bme temo\b|\bdesafortunadamente,? no\b",
        )
    )
)
# Each way to decline has one of these in it.
HINTS = (
    "i'm", "i’m", "i am", "i can", "i won", "i will", "i could", "i may", "i must", "i have to", "i need to", "i regret", "i respect", "i decline", "i refuse",
    "i do", "i lack", "i'd", "i’d", "i would", "i prefer", "as a", "appropriate for me", "nothing i", "permitted", "my ", "what i", "unanswered", "no can do",
    "limits", "reply is not", "regrettably", "sorry", "apolog", "unfortunately", "unable to", "leid", "ich ", "sprachmodell", "als ki", "auskunft", "désol",
    "je ", "impossible", "en tant que", "malheureusement", "siento", "no p", "no d", "no m", "no t", "no e", "prefiero", "modelo", "lamento", "temo", "desafort",
    "let us", "let's", "let’s", "about something", "about anything", "topic", "subject", "no comment", "etwas ander", "das thema", "autre chose", "de sujet", "otra cosa", "de tema",
)
# Sentences around a refusal that answer nothing: thanks, greetings, understanding, offers, wishes.
POLITE = re.compile(
    r"^\W*(?:"
    + "|".join(
        (
            r"(?:many |my )?thanks?\b(?! to\b)[^:;,]*(?:, [^\W\d_]+)?|(?:hello|hi|hey|dear|good (?:morning|afternoon|evening))\b(?: [^\W\d_]+){0,3}",
            r"(?:what an?|that['’]?s an?|that is an?|an?|this is an?)?\s*(?:very |really )?(?:good|great|interesting|excellent|fair|nice|important) question\b[^:;,]*",
            r"i (?:do |fully |can )?(?:understand|appreciate|see|realise|realize|hear) (?:that |why |how )?(?:you|your|the question|the request|this question)\b[^:;]*",
            r"(?:but )?(?:please )?(?:do )?(?:ask|feel free|let me know|try asking|choose another|rephrase)\b[^:;]*|i(?:['’]m| am|['’]d be| would be) (?:happy|glad) to (?:help|assist|answer)\b[^:;]*",
            r"if (?:you|there) (?:have|need|want|would like|is) (?:to ask )?(?:any|some|an?)?(?:thing)?\s*(?:other|more|further|else|different|help|questions?)\b[^:;]*",
            r"(?:i|we) hope (?:you understand|for your understanding)\b[^:;]*|have an? (?:nice|good|great|pleasant)\b[^:;]*|(?:best|kind) (?:wishes|regards)\b[^:;]*",
            r"(?:vielen |besten |herzlichen )?dank(?:e)?\b[^:;,]*(?:, [^\W\d_]+)?|hallo\b[^:;,]*|guten (?:morgen|tag|abend)\b[^:;,]*|(?:das ist )?(?:eine )?(?:sehr )?(?:gute|interessante) frage",
            r"ich verstehe(?:,? (?:dass|warum) sie|,? (?:ihr|die frage))\b[^:;]*|(?:bitte )?(?:fragen|stellen|melden) sie\b[^:;]*|gerne? helfe ich\b[^:;]*",
            r"(?:je vous remercie|merci)\b[^:;,]*(?:, [^\W\d_]+)?|bonjour\b[^:;,]*|bonsoir\b[^:;,]*|(?:c['’]est )?(?:une )?(?:très )?(?:bonne|excellente) question|je comprends (?:votre|que vous)\b[^:;]*",
            r"n['’]hésitez pas\b[^:;]*|(?:veuillez|posez)\b[^:;]*\bquestions?\b[^:;]*",
            r"(?:muchas )?gracias\b(?! a\b)[^:;,]*(?:, [^\W\d_]+)?|hola\b[^:;,]*|buen[oa]s (?:días|tardes|noches)\b[^:;,]*|(?:es )?(?:una )?(?:muy )?(?:buena|excelente) pregunta|entiendo (?:su|tu|que)\b[^:;]*",
            r"no dud[ea]s? en\b[^:;]*|por favor,? (?:pregunt|consult)\w*[^:;]*",
        )
    )
    + r")\W*$|\?\W*$"
)
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*", re.U)
TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[.!?…。]+|[^\w\s]", re.U)
SENTENCE_END = re.compile(r"[.!?…。]['\"”»)\]*_]*$")
ITEM = re.compile(r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]+(\S.*)$", re.M)
ITEM_END = re.compile(r"^([ \t]*(?:[-*•]|\d+[.)])[ \t]+\S.*[^\W_])[ \t]*(?=\n\s*(?:\n|[-*•][ \t]|\d+[.)][ \t]))", re.M)
PLAIN_END = re.compile(r"(?:^|\n)[ \t]*(?:[^\W\d_][^\n:.!?]{0,24}:[ \t]*\S+(?: \S+)?|\|.*\|)$")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@functools.lru_cache(maxsize=50_000)
def words_of_instruction(text: str | None) -> list[str]:
    return words(text)


def is_empty(output: str | None) -> bool:
    """No letter or digit left without mark-up, labels and words for a missing answer."""
    if not output:
        return True
    if "<" not in output and sum(map(str.isalnum, output.split())) > 4:
        return False
    bare = re.sub(r"</?[a-zA-Z][^>]*>", " ", output)
    bare = LABEL_START.sub(" ", bare)
    bare = " ".join(re.findall(r"[^\W_]+", bare.lower()))
    return not bare or bare in NOTHING


def declines(sentence: str) -> bool:
    low = sentence.lower()
    return any(map(low.__contains__, HINTS)) and bool(REFUSALS.search(low))


def is_refusal(output: str) -> bool:
    """Outside quotations, the first sentence declines to answer, or a later one does and none answers.

    Thanks, greetings, questions and offers around a refusal are no answers. The first sentence that
    answers settles it, so nothing after it is looked at.
    """
    refused = False
    for k, sentence in enumerate(re.split(r"(?<=[.!?])\s+", QUOTED.sub(" ", output).strip())):
        if declines(sentence):
            if k == 0:
                return True
            refused = True
        elif not POLITE.search(sentence.lower()):
            return False
    return refused


def shared_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of ``b``."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if here := row & places.get(x, 0):
            row = (row + here | row - here) & full
    return len(b) - row.bit_count()


def repeated_words(said: list[str], source: list[str], least: float) -> int:
    """Words of ``said`` that go along with ``source`` said over and over, block by block; 0 once fewer than ``least`` are possible.

    A block is aligned with the source said twice, so that words left out before do not shift it.
    """
    common, size = 0, len(source)
    for at in range(0, len(said), size):
        block = said[at : at + size]
        common += shared_words(block, source * 2)
        if common + len(said) - at - len(block) < least:
            return 0
    return common


def compressed_share(text: str, dictionary: str) -> float:
    """Bytes that ``text`` still takes under ``dictionary``, as a share of its own."""
    import zstandard

    data = text.encode()
    known = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False).compress(data)
    return max(0, len(packed) - 9) / max(1, len(data))


def is_copy(instruction: str | None, input_: str | None, output: str) -> bool:
    """The response only repeats the instruction, the whole input, or both, perhaps slightly altered."""
    said = words(LABEL_START.sub("", output))
    sources = [s for s in (words_of_instruction(instruction), words(input_)) if s]
    if not said or not sources:
        return False
    if len(sources) == 2:
        sources.append(sources[0] + sources[1])
    text = " ".join(said)
    if len(said) >= 6 and compressed_share(text, " \n ".join(" ".join(s) for s in sources[:2])) > COPY_RATIO:
        return False
    for source in sources:
        times = max(1, round(len(said) / len(source)))
        if len(said) < COPY_SHARE * len(source):
            continue
        common = shared_words(said, source * times) if times <= 5 else repeated_words(said, source, (1 - (1 - COPY_SHARE) / 2) * len(said))
        if common >= COPY_SHARE * len(source) * times and common >= (1 - (1 - COPY_SHARE) / 2) * len(said) and (len(source) > 2 or common == len(source) * times):
            return True
    return False


def language_scores(text: str | None) -> dict[str, int]:
    counts = [0] * len(_LANGUAGES)
    said = Counter(LETTERS.findall(text.lower())) if text else {}
    for w in said.keys() & _LANGUAGES_OF.keys():
        for k in _LANGUAGES_OF[w]:
            counts[k] += said[w]
    return dict(zip(_LANGUAGES, counts))


def language_of(text: str | None, least: int = 2, margin: float = 1.5) -> str | None:
    """The language whose function words prevail, or None."""
    scores = sorted(language_scores(text).items(), key=lambda x: -x[1])
    (best, n), (_, second) = scores[0], scores[1]
    return best if n >= least and n >= margin * second else None


@functools.lru_cache(maxsize=50_000)
def asked_languages(instruction: str | None) -> tuple[frozenset[str], str | None]:
    """(languages that an instruction names, its own one)."""
    named = {lang for lang, name in _ASKED.items() if name.search(instruction)} if instruction and _ANY_ASKED.search(instruction) else ()
    return frozenset(named), language_of(instruction, 1, 1.2)


def expected_languages(instruction: str | None, input_: str | None) -> set[str] | frozenset[str]:
    """The languages that the instruction names, else those of instruction and input."""
    named, own = asked_languages(instruction)
    return named or {x for x in (own, language_of(input_)) if x}


def is_foreign(text: str, expected: set[str]) -> bool:
    """Running text in a language that FUNCTION_WORDS lacks: another script, or next to none of the expected languages' words.

    Judged are texts of FOREIGN_WORDS different lower-case words and more with the end of a sentence.
    """
    letters = [c for c in text if c.isalpha()]
    if len(letters) >= 20 and sum(c > "\u024f" for c in letters) >= 0.6 * len(letters):
        return True
    said = LETTERS.findall(text)
    small = sum(w[0].islower() for w in said)
    if len({w for w in said if w[0].islower()}) < FOREIGN_WORDS or small < 0.6 * len(text.split()) or not re.search(r"[.!?…]", text):
        return False
    scores = language_scores(text)
    return max(scores[x] for x in expected) < FOREIGN_SHARE * len(said)


def is_wrong_language(instruction: str | None, input_: str | None, output: str) -> bool:
    plain = re.sub(r"```.*?(?:```|$)", " ", output, flags=re.S) if "```" in output else output
    actual = language_of(plain)
    named, own = asked_languages(instruction)
    if actual is not None and not named and own == actual:
        return False
    expected = expected_languages(instruction, input_)
    if actual is None:
        return bool(expected) and is_foreign(plain, expected)
    return bool(expected) and actual not in expected


def ends_in_short_item(text: str) -> bool:
    """The last line is a list item of one or two words, as are most of the list's other items."""
    items = list(ITEM.finditer(text))
    if not items or items[-1].end() != len(text):
        return False
    sizes = [len(WORD.findall(m.group(1))) for m in items]
    return sizes[-1] <= 2 and 2 * sum(n <= 2 for n in sizes[:-1]) >= len(sizes) - 1


def open_end(output: str) -> tuple[bool | None, str, str]:
    """(True: breaks off, False: whole, None: the last two words decide, word before last, last word)."""
    text = output.strip()
    if text.count("```") % 2:
        return True, "", ""
    if text.endswith("```") or SENTENCE_END.search(text) or PLAIN_END.search(text) or ends_in_short_item(text):
        return False, "", ""
    tokens = TOKEN.findall(text.lower())
    spoken = [t for t in tokens if t[0].isalnum()]
    if len(spoken) < 4:
        return False, "", ""
    if not tokens[-1][0].isalnum() and tokens[-1] not in "\"'”»)]*":
        return True, "", ""
    return None, spoken[-2], spoken[-1]


def first_label(instruction: str | None, input_: str | None, output: str | None) -> tuple[str | None, str | None, str | None]:
    """(defect, word before last, last word); the words are given where the model has to decide."""
    if is_empty(output):
        return "empty", None, None
    if is_refusal(output):
        return "refusal", None, None
    if is_copy(instruction, input_, output):
        return "copy", None, None
    if is_wrong_language(instruction, input_, output):
        return "wrong_language", None, None
    broken, before, last = open_end(output)
    if broken is None:
        return None, before, last
    return ("truncated" if broken else None), None, None


def _context_counts(texts: list[str | None], asked: frozenset[str] | None = None) -> Counter:
    """How often two words stand together, and whether a sentence ends there; only for the ``asked`` second words, if given."""
    counts: Counter = Counter()
    for text, times in Counter(texts).items():
        if text:
            t = TOKEN.findall((ITEM_END.sub(r"\1.", text) if "\n" in text else text).lower())
            for k, b in enumerate(t[1:-1], 1) if asked is None or not asked.isdisjoint(t) else ():
                if (b[0].isalnum() if asked is None else b in asked) and t[k - 1][0].isalnum():
                    counts[t[k - 1], b, t[k + 1][0] in ".!?…。"] += times
    return counts


def terminal_contexts(rows: DataFrame, asked: DataFrame | None = None, columns: tuple[str, ...] = ("instruction", "input", "output", "context"), most_asked: int = MOST_ASKED) -> DataFrame:
    """(before, last, ends, uses): how often two words stand together, and end a sentence there.

    ``asked`` (last) has the words that the counts are needed for; up to ``most_asked`` of them are sent to
    where texts are counted, else all words are counted.
    """
    few = asked is not None and asked.count() <= most_asked
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in asked.toLocalIterator()) if few else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for c in columns:
                counts.update(_context_counts(pdf[c].tolist(), sent.value))
            yield pd.DataFrame([(a, b, n if e else 0, n) for (a, b, e), n in counts.items()], columns=["before", "last", "ends", "uses"])

    parts = rows.select(*columns).mapInPandas(count, "before string, last string, ends bigint, uses bigint")
    return parts.groupBy("before", "last").agg(F.sum("ends").alias("ends"), F.sum("uses").alias("uses"))


def pair_defects(examples: DataFrame) -> DataFrame:
    """(example_id, defect): one row per defective pair, in the order of DEFECTS where several apply.

    Repeated rows of an example_id count once (the latest created_at); rows with a null id are left
    out. A null output is empty; null instruction or input count as absent, and without either
    nothing can be a copy or in the wrong language. Extra columns are ignored; an empty table gives
    an empty result.
    """
    latest = (
        examples.where(F.col("example_id").isNotNull())
        .groupBy("example_id")
        .agg(F.max(F.struct("created_at", "output", "instruction", "input", "context")).alias("v"))
        .select("example_id", "v.instruction", "v.input", "v.output", "v.context")
    )
    id_type = latest.schema["example_id"].dataType.simpleString()

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [first_label(a, b, c) for a, b, c in zip(pdf["instruction"], pdf["input"], pdf["output"])]
            out = pd.DataFrame(found, columns=["defect", "before", "last"])
            out.insert(0, "example_id", pdf["example_id"].to_numpy())
            yield out[out["defect"].notna() | out["last"].notna()]

    labels = latest.select("example_id", "instruction", "input", "output").mapInPandas(
        label, f"example_id {id_type}, defect string, before string, last string"
    )
    labels = cut_lineage(labels)
    counts = cut_lineage(terminal_contexts(latest, labels.where(F.col("last").isNotNull()).select("last").distinct()))
    by_word = counts.groupBy("last").agg(F.sum("ends").alias("word_ends"), F.sum("uses").alias("word_uses"))
    judged = (
        labels.join(counts, ["before", "last"], "left")
        .join(by_word, "last", "left")
        .withColumn("prior", (F.coalesce("word_ends", F.lit(0)) + 0.3) / (F.coalesce("word_uses", F.lit(0)) + 1.0))
        .withColumn("p_end", (F.coalesce("ends", F.lit(0)) + 2 * F.col("prior")) / (F.coalesce("uses", F.lit(0)) + 2.0))
    )
    broken = F.col("defect").isNull() & (F.col("p_end") < END_SHARE)
    return judged.select("example_id", F.coalesce("defect", F.when(broken, "truncated")).alias("defect")).where(F.col("defect").isNotNull())
