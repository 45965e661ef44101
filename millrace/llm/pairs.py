"""Defects of question and answer pairs.

Each pair has at most one defect, the first that holds of: ``empty``, ``refusal``, ``copies_question``,
``wrong_language``, ``truncated``.

* empty, refusal: dictionaries of marks, stock words and declining phrases. A refusal declines in one of its clauses, and
  all others are courtesies: opening and closing phrases that give nothing of what was asked.
* copies_question: the answer is compressed with its question as a zstandard dictionary. What the dictionary
  can't supply is new text; an answer as long as the question with next to no new text repeats it.
* wrong_language: dictionaries of function words and the scripts of the letters; the answer speaks for another language
  more than for any that the question may be in.
* truncated: open brackets and quotes, hanging marks, and for answers without a final mark a terminal-context model:
  the probability that a sentence ends after the last word, estimated over the distinct texts of all pairs and
  backed off from the word to its last three letters and to all words, against how often answers of this length
  have a final mark; and for words that occur nowhere else, how often words end in their last three letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import get_close_matches
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged

#: Stock words that stand for a missing answer, compared without brackets and marks around them (fixed values).
STOCK = frozenset(
    "null|none|nil|nan|n/a|na|n.a|tbd|tba|tbc|todo|empty|blank|missing|no answer|no response|not available|not applicable|not answered|answer pending|pending|answer missing|missing answer|"
    "unanswered|no reply|no output|no content|undefined|to be determined|to be added|placeholder|insert answer here|answer here|answer to follow|left blank|keine antwort|sin respuesta|sans réponse|pas de réponse".split("|")
)
#: What a pair's answer says when it declines (fixed values), after lower-casing and with straight apostrophes.
_DO = r"(?:help|assist|answer|respond|reply|provide|comply|discuss|share|say|do th|fulfil|support|continue|talk|engage|generate|complete|offer|give|go into|comment)"
REFUSALS = re.compile(
    r"\bi (?:must|have to|will have to|need to) (?:respectfully )?(?:refuse|decline|pass)\b|\bi(?: would|'d) (?:rather|prefer) not\b|\bi(?: would|'d) prefer to pass\b|"
    r"\bi(?:'m| am)? ?(?:can't|cannot|can not|won't|will not|could not|unable to|not able to|not allowed to|not permitted to|not in a position to|not going to|refuse to|decline to|choose not to) " + _DO + r"|"
    r"\bguidelines (?:don't|do not|won't) (?:let|allow|permit)|\b(?:falls|is|lies) outside (?:of )?what i\b|\bno answer can be given\b|\bsomething i (?:must|have to) (?:decline|refuse)|"
    r"\bi (?:refuse|decline)[.! ]*$|\bi (?:can't|cannot) (?:be of (?:help|assistance))|"
    r"\bkann ich (?:leider )?(?:dabei |dazu |hier |darauf |das |ihnen |dir )*nicht\b|\bkann (?:ich )?(?:leider )?nicht (?:helfen|antworten|beantworten)|\bdarf ich (?:leider )?(?:dazu |das )?nicht\b|\bmöchte ich (?:lieber )?(?:dazu )?nicht\b|\bich muss (?:das |dies )?(?:leider )?ablehnen|"
    r"\bje ne (?:peux|puis|suis pas en mesure|souhaite|veux) (?:pas )?|\bje (?:dois|préfère) (?:refuser|décliner|ne pas)|"
    r"\bno (?:puedo|podría|estoy en condiciones de|me es posible|quiero) (?:ayudar|responder|contestar|hacer|decir|dar|proporcionar)|\bprefiero no\b|\b(?:debo|tengo que) (?:rechazar|negarme|declinar)"
)
#: Words of courtesies around a refusal (fixed values).
COURTESY = frozenset(
    "sorry apologies apologise apologize regret regrettably unfortunately afraid thank thanks please kindly ask asking asked question questions request requests topic topics subject matter help assist assistance answer answers answering respond response reply "
    "provide discuss discussing say share feel free happy glad welcome else something anything everything someone anyone here there again instead another other others different further more contact consult reach out turn try team support office council company department expert experts specialist specialists professional person people respect respectfully "
    "assistant model ai language policy policies guideline guidelines rule rules allowed able unable permitted limits limit scope outside beyond understand appreciate know hope let me see time today always never gladly like want need wish offer talk point direct refer concerns sensitive safety appropriate comply "
    "entschuldigung leid tut mir dir ihnen dabei dazu darauf damit hierzu bedaure leider bitte danke frage fragen thema anfrage helfen gern gerne wenden verständnis désolé désolée pardon regrette malheureusement merci veuillez demande demander question sujet aider lo siento lamento disculpe perdón gracias por favor pregunta preguntar tema ayudar".split()
)
#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that a an for it with as was on be by at this are or from which not but have has had they you we he she his her its their there when where who what why how if then than so because would could should can will may must into over under about after before between each every some any no nor only those these them us our your my me him were been being do does did while although since until unless instead",
    "de": "der die das und ist nicht ein eine einen einem einer eines mit von zu den dem des auf für wird werden sind wir ich nach bei als auch im am um aus wenn oder aber wie noch nur über vor zur zum vom sich es er sie ihr ihre ihren sein seine haben hat war wurde durch gegen ohne weil dass damit dann dort hier sehr kein keine muss müssen kann können soll sollte wer was wo wann warum welche welcher welches während obwohl sofern sowie damals später ungefähr etwa",
    "fr": "le la les des et est une un du dans pour que qui ne pas sur avec sont nous par au aux ce cette ces il elle ils elles on en se sa son ses leur leurs mais ou où donc car si quand comme plus moins très être avoir été fait je tu vous mon ton notre votre après avant depuis pendant sans sous entre chez vers tout toute tous toutes aussi puis alors afin lorsque puisque sauf près c'était d'une qu'elle d'un l'on y",
    "es": "el la los las y es un una unos unas de del que en para con por no se su sus al lo como más este esta estos estas ese esa esos esas pero o si cuando donde muy ser estar ha han fue era son hay ya también después antes desde hasta sin sobre entre todo toda todos todas cada yo tú él ella nosotros ustedes mi tu nuestro nuestra nuestros nuestras porque aunque mientras según salvo cerca allí aquí qué cuál quién cómo cuánto cuántos",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla dai dalle in nel nello nella nei negli nelle con su sul sulla sui sulle per tra fra e ed o ma se che chi cui non più come quando dove perché anche è sono era erano ha hanno essere avere questo questa questi queste quello quella ogni tutto tutti tutte suo sua loro noi voi io tu lui lei si ci vi ne dopo prima fino senza sopra sotto mentre quindi però già ancora",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sob sobre entre e ou mas se que quem qual quando onde como porque não mais muito também já ainda é são foi eram ser ter há tem têm seu sua seus suas este esta estes estas esse essa isso ele ela eles elas nós você vocês eu ao aos às após até desde depois antes cada todo toda todos todas embora enquanto",
    "nl": "de het een en van in op te dat die dit deze is zijn was waren wordt worden met voor aan bij naar om uit over door tot als maar of niet geen ook nog wel dan er hier daar hij zij ze wij we je jij ik mijn zijn haar hun ons onze wat wie waar wanneer hoe waarom heeft hebben had kan kunnen moet moeten zal zullen zou want omdat terwijl na tussen onder tegen zonder elke alle veel meer",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {}
for _k, _v in _FUNCTION.items():
    for _w in _v:
        _LANGUAGES_OF.setdefault(_w, []).append(_k)
#: Letters that speak for one of these languages (fixed values).
MARKS = {"de": "äöüß", "fr": "çèêëîïôûœàù", "es": "ñ¿¡áíóú"}
#: Scripts by code point ranges (fixed values).
SCRIPTS = (("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("greek", 0x370, 0x3FF))
_MARKED = re.compile("[" + "".join(MARKS.values()) + "]")
_OTHER = re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for _, a, b in SCRIPTS) + "]")

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_FINAL = re.compile(r"([^\W_]+(?:['’][^\W\d_]+)*)[\"'”’»)\]]*[.!?。！？…]+[\"'”’»)\]]*(?=\s|$)")
_ENDED = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*$|[)\]}”»*`]$|(?<=[^\s])[\"']$")
_HANGING = re.compile(r"(?:…|\.\.+|[-–—,;:/&+=(\[{<])[\"'”’»)\]]*$")
_LIST_MARK = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•])\s*$")
_QUOTED = re.compile(r"\"[^\"]{1,80}\"|“[^”]{1,80}”|„[^“”]{1,80}[“”]|«[^»]{1,80}»")
_INVISIBLE = re.compile(r"[\s­͏؜᠎​-‏ - ⁠-⁯　ㅤ︀-️﻿\x00-\x1f\x7f]+")
_LETTER_OR_DIGIT = re.compile(r"[^\W_]")

#: Share of new bytes up to which an answer counts as supplied by its question, and bytes that any answer costs.
NEW_SHARE, NEW_BYTES = 0.30, 14
#: Words of the answer that the question must have (both counted with repetition, the question up to twice), and share of the question that must come back.
COPY_WORDS, COPY_COVER, LABEL = 0.85, 0.6, 5
#: A text with a final mark, for the JVM.
FINAL_MARK = r"[.!?。！？)\]}”»*`\"'’_]\s*$"
#: An unended answer is cut if a sentence ends after its last word with less than this probability, times the share of
#: answers of its length that have a final mark (not below FLOOR: function words end phrases neither).
ENDS, FLOOR = 0.006, 0.15
#: Weight, in occurrences, of the estimate that a word's is backed off to: of its last three letters, of stumps of up to
#: two letters, and of function words, which are expected to end one sentence in a thousand.
BACK_OFF, STUMP, FUNCTION_PRIOR = 30.0, (6.0, 0.02), (50.0, 0.001)


def is_empty(answer: str | None) -> bool:
    """Null, nothing visible, only a mark, or a stock word."""
    if answer is None:
        return True
    seen = _INVISIBLE.sub(" ", answer).strip()
    if not _LETTER_OR_DIGIT.search(seen):
        return True
    return seen.lower().strip("<>[](){}*_-–—.!?:;,'\"` ") in STOCK


_CLAUSE = re.compile(r"[.!?:;]+(?:\s+|$)|\n|\s+[-–—]\s+|,?\s+\b(?:but|however|aber|jedoch|mais|pero|sino)\b")


def _courtesy(clause: str, known: frozenset[str]) -> bool:
    """No number, and no more new words than words of courtesy, or one; function words, names and words of the question aren't new."""
    words = _TOKEN.findall(clause.replace("’", "'"))
    if not words:
        return True
    if any(c.isdigit() for w in words for c in w if w.lower() not in known):
        return False
    own = [w for w in words if w.lower() not in _LANGUAGES_OF]
    polite = sum(w.lower() in COURTESY for w in own)
    new = sum(not (w[0].isupper() or (x := w.lower()) in COURTESY or x in known or "'" in x) for w in own)
    return new <= max(1, polite)


@lru_cache(maxsize=4096)
def _known(question: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(question.lower()))


def is_refusal(answer: str, question: str | None = None) -> bool:
    """A clause declines, wherever it stands, and all others are courtesies."""
    a = answer.replace("’", "'").strip()
    low = a.lower()
    if len(low) != len(a):  # lower case of other length, as of a dotted capital I
        a = low
    m = REFUSALS.search(low)
    if not m:
        return False
    known = _known(question) if question else frozenset()
    at, start = [x.end() for x in _CLAUSE.finditer(a)], 0
    for end in [*at, len(a)]:
        clause = a[start:end]
        declines = REFUSALS.search(low[start:end])
        if declines:
            # what is declined may be named at any length, but with no number of its own
            fine = not any(c.isdigit() for w in _TOKEN.findall(clause) if w.lower() not in known for c in w) and _courtesy(clause[: declines.start()], known)
        else:
            fine = m.end() > start and m.start() < end or _courtesy(clause, known)
        if not fine:
            return False
        start = end
    return True


@lru_cache(maxsize=512)
def _against(question: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(question * (8 // len(question) + 1) if len(question) < 8 else question, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def copies(question: str, answer: str) -> bool:
    """The answer has about all of the question and next to nothing else.

    A label of up to ``LABEL`` words before the question's first two words is left off. New words after the last
    word of the question, if they aren't near spellings, and new numbers are an answer.
    """
    q, a = _TOKEN.findall(question.lower()), _TOKEN.findall(answer.lower())
    if len(q) > 1 and a[:2] != q[:2]:
        a = next((a[i:] for i in range(1, LABEL + 1) if a[i : i + 2] == q[:2]), a)
    if not q or len(a) < max(1, COPY_COVER * len(q)):
        return False
    qb, ab = " ".join(q).encode("utf-8", "replace"), " ".join(a).encode("utf-8", "replace")
    if len(_against(qb).compress(ab)) > NEW_BYTES + NEW_SHARE * len(ab):
        return False
    left = Counter(q)
    new = [w not in left for w in a]
    tail = a[len(a) - new[::-1].index(False) :] if False in new else a
    if any(n and any(c.isdigit() for c in w) for w, n in zip(a, new)) or any(not get_close_matches(w, left, 1, 0.7) for w in tail):
        return False
    found = sum((Counter(a) & left).values())
    covered = found / len(q)
    twice = sum((Counter(a) & Counter({w: 2 * n for w, n in left.items()})).values())
    return covered >= COPY_COVER and twice >= COPY_WORDS * len(a)


def language(text: str) -> tuple[dict[str, int], int]:
    """Evidence for each language or script, and the number of words; quoted parts and letters of names don't count."""
    if _OTHER.search(text):
        other = Counter(next((n for n, a, b in SCRIPTS if a <= ord(c) <= b), None) for c in _OTHER.findall(text))
        letters = sum(c.isalpha() for c in text)
        n = sum(other.values())
        if n > 0.5 * letters:
            return {("han" if "kana" not in other else "kana") if {"han", "kana"} & set(other) else other.most_common(1)[0][0]: n}, n
    own = _QUOTED.sub(" ", text).replace("’", "'")
    low = own.lower()
    words = _TOKEN.findall(low)
    score: Counter = Counter()
    for w in words:
        for k in _LANGUAGES_OF.get(w, ()):
            score[k] += 1
    if _MARKED.search(low):
        plain = [w for w in _TOKEN.findall(own) if w[0].islower()]
        for k, marks in MARKS.items():
            score[k] += sum(any(c in marks for c in w) for w in plain) + (k == "es" and ("¿" in low or "¡" in low))
    return score, len(words)


@lru_cache(maxsize=4096)
def _asked(question: str) -> tuple[frozenset[str], int]:
    """The languages a question may be in, those with the most evidence, and how much they have before the others; prompts are asked again and again."""
    score, _ = language(question)
    most = max(score.values(), default=0)
    if not most:
        return frozenset(), 0
    rest = [n for n in score.values() if n < most]
    return frozenset(k for k, n in score.items() if n == most), most - max(rest, default=0)


def other_language(question: str, answer: str) -> bool:
    """The answer is clearly of one language or script and the question clearly of another."""
    score, n = language(answer)
    best = max(score.values(), default=0)
    if not best:
        return False
    may, q_sure = _asked(question)
    if not may or {"han", "kana"} & may and {"han", "kana"} & set(score):
        return False
    if not set(score) & set(FUNCTION_WORDS):
        return n >= 2 and not may & set(score)
    if may & set(FUNCTION_WORDS) and q_sure < 2 and len(may) == 1:
        return False
    sure = best - max(score.get(k, 0) for k in may)
    return sure >= 2 or sure == 1 and n >= 2 and 6 * sure >= n


def _open_at_end(a: str) -> bool:
    """A bracket or quote is open, and the text doesn't end a sentence or does so within two words of it."""
    opened = [a.rfind(x) for x, y in ("()", "[]", "{}", "«»") if a.count(x) > a.count(y)]
    if a.count('"') % 2:
        opened.append(a.rfind('"'))
    if a.count("“") > a.count("”") + a.count("„"):
        opened.append(a.rfind("“"))
    return bool(opened) and (not _ENDED.search(a) or a[-1] in '"([{' or len(_TOKEN.findall(a[max(opened) :])) <= 2)


def verdict(question: str | None, answer: str | None) -> tuple[str | None, str | None, int]:
    """(defect, None, 0), or for an answer without a clear end (None, its last word, number of words)."""
    if is_empty(answer):
        return "empty", None, 0
    if is_refusal(answer, question):
        return "refusal", None, 0
    if question and copies(question, answer):
        return "copies_question", None, 0
    if question and other_language(question, answer):
        return "wrong_language", None, 0
    a = _INVISIBLE.sub(" ", answer).strip()
    if _open_at_end(a):
        return "truncated", None, 0
    if _HANGING.search(a) or _LIST_MARK.search(answer):
        return "truncated", None, 0
    if _ENDED.search(a):
        return None, None, 0
    words = _TOKEN.findall(a)
    if not words or _OTHER.search(words[-1]):
        return None, None, 0
    return None, words[-1], len(a.split())


def last_form(word: str) -> str:
    """The form under which a word is counted: words with digits are one word, case is kept off."""
    return "0" if any(c.isdigit() for c in word) else word.lower()


def _counts(texts: DataFrame) -> DataFrame:
    """(word, inside, ends): occurrences but for unended last words, and ends of sentences, of all texts of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside: Counter = Counter()
            ends: Counter = Counter()
            for t in b.column(0).to_pylist():
                words = _TOKEN.findall(t)
                inside.update(words)
                ends.update(_FINAL.findall(t))
                if words and not _ENDED.search(t.rstrip()):
                    inside[words[-1]] -= 1
            folded: dict = {}
            for w, n in inside.items():
                x = folded.setdefault(last_form(w), [0, 0])
                x[0] += n
                x[1] += ends.get(w, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(folded)), pa.array([x[0] for x in folded.values()], pa.int64()), pa.array([x[1] for x in folded.values()], pa.int64())], names=["word", "inside", "ends"])

    part = texts.mapInArrow(run, "word string, inside long, ends long")
    return part.groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))


def distinct_texts(df: DataFrame) -> DataFrame:
    """Each non-empty text of all columns once, so that copies of one text count as one; combined by hash before the shuffle."""
    one = df.select(F.explode(F.array(*df.columns)).alias("t")).filter("length(t) > 0")
    return one.groupBy(F.xxhash64("t").alias("x"), F.md5("t").alias("y")).agg(F.first("t").alias("t")).select("t")


def _octave(words: Column) -> Column:
    """Lengths in quarters of an octave."""
    return F.floor(4 * F.log2(F.greatest(words, F.lit(1)))).cast("int")


def pair_defects(pairs: DataFrame, question: str, answer: str, keys: list[str]) -> DataFrame:
    """keys and defect of each defective pair.

    Every row is judged, repeated ones too. A null question leaves the checks that need it undone. Rows of an
    empty table give none. Columns besides keys, question and answer are ignored.
    """
    d = pairs.select(*keys, F.col(question).cast("string").alias("__q"), F.col(answer).cast("string").alias("__a"))
    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [verdict(q, a) for q, a in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist())]
            keep = pa.array([x[0] is not None or x[1] is not None for x in got])
            cols = [*b.columns[: len(keys)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "defect", "last", "words"]).filter(keep)

    judged = staged(d.mapInArrow(run, f"{kinds}, defect string, last string, words int"), "judged")
    sure = judged.filter("defect is not null").select(*keys, "defect")
    open_ = judged.filter("defect is null").withColumn("word", F.when(F.col("last").rlike(r"\p{N}"), "0").otherwise(F.lower("last")))
    words = staged(_counts(distinct_texts(d.select("__q", "__a"))), "words")
    # by the last three letters, of which there are at most 60 ** 3: how often words end in them, and sentences after such words
    letters = words.filter(F.col("word").rlike(r"^[a-zß-ÿœ]{4,40}$") & (F.col("inside") > 0))
    none = F.lit(0).cast("long")
    tails = letters.select(F.substring("word", -3, 3).alias("tail"), F.lit(1).alias("at_end"), "inside", "ends")
    grams = letters.select(F.explode(F.expr("transform(sequence(1, length(word) - 3), i -> substring(word, i, 3))")).alias("tail"), F.lit(0).alias("at_end"), none.alias("inside"), none.alias("ends"))
    tails = tails.unionByName(grams).groupBy("tail").agg(F.avg("at_end").alias("tail_ends"), F.sum("inside").alias("tail_inside"), F.sum("ends").alias("tail_stops"))
    base = words.agg((F.sum("ends") / F.sum("inside")).alias("base"))  # one row
    # how many answers of a length have a final mark; lengths in quarters of an octave, so a few hundred rows at most
    n = F.size(F.split(F.trim(F.regexp_replace("__a", r"(?U)\s+", " ")), " "))
    lengths = d.filter("length(trim(__a)) > 0").groupBy(_octave(n).alias("octave")).agg(F.avg(F.col("__a").rlike(FINAL_MARK).cast("double")).alias("marked"))
    x = spread_join(open_, words, ["word"], "left", by=keys).withColumn("tail", F.substring("word", -3, 3)).withColumn("octave", _octave(F.col("words")))
    x = x.join(F.broadcast(tails), "tail", "left").join(F.broadcast(lengths), "octave", "left").join(F.broadcast(base))
    small = F.col("last") == F.lower("last")
    function = F.lower("last").isin(*sorted(set().union(*_FUNCTION.values())))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    p_tail = (zero("tail_stops") + BACK_OFF * F.coalesce("base", F.lit(0.0))) / (zero("tail_inside") + BACK_OFF)
    stump = F.length("last") <= 2
    weight = F.when(function, FUNCTION_PRIOR[0]).when(stump, STUMP[0]).otherwise(BACK_OFF)
    prior = F.when(function, FUNCTION_PRIOR[1]).when(stump, STUMP[1]).otherwise(p_tail)
    p = (zero("ends") + weight * prior) / (zero("inside") + weight)
    marked = F.greatest(F.coalesce("marked", F.lit(1.0)), F.lit(FLOOR))
    cannot_end = (p < ENDS * F.when(function, 1.0).otherwise(marked)) & (small | function)
    unknown = zero("inside") <= 0
    seldom_last = (F.length("last") < 3) | (F.coalesce("tail_ends", F.lit(0.0)) < 0.5)
    mostly_marked = F.coalesce("marked", F.lit(1.0)) > 0.5
    cut_word = unknown & (F.col("words") > 1) & ((small & mostly_marked) | (seldom_last & (small | mostly_marked)))
    return sure.unionByName(x.filter((cannot_end | cut_word) & (F.col("word") != "0")).select(*keys, F.lit("truncated").alias("defect")))
