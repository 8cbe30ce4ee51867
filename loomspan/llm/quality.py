"""Quality rules: a threshold table compiled into one projection of built-in expressions.

A rule bounds a ratio. Its row in the table may also say which words it counts and where it holds:
the rule of function words counts those of the languages in ``STOP_WORDS`` and is left out for
texts that are mostly written in another script than these.

Defined results: a null text has no words, so every count is 0, ``base_failed`` is true and
``kept`` false; an empty text likewise. Very long texts cost n log n of their own length and no
shuffle. Repeated rows are judged one by one. Other columns of the input, whatever their names,
pass through ``quality_filter`` and are dropped by ``quality_report``. An empty table gives an
empty result. A null ``doc_id`` is kept as null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.words import table, words_of

WINDOW = 8
NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: The commonest function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was be with as this by are from or an at not he have",
    "de": "der die das und in den von zu ist mit im für auf eine ein dem des nicht sich als auch es an werden aus",
    "fr": "de la le et les des en un une du est que dans qui par pour sur au pas il avec ce sont plus se ne",
    "es": "el los las que y del por con para una su es al lo como más pero sus o este sí",
    "it": "di che il per non una della sono con si le da come anche nel alla gli",
    "pt": "de que não do da em para com uma os no se na por mais as dos como mas foi",
    "nl": "het een van en dat niet op te zijn met voor er maar om ook aan bij",
    "pl": "nie się na że jest do to jak ale po co za tak od przez dla który",
    "ru": "и в не на что я с он как это по но из у за так же от для был",
}
#: The scripts that these languages are written in.
SCRIPTS = ("Latin", "Cyrillic")


@dataclass(frozen=True)
class Rule:
    """``least <= ratio <= most`` must hold; a bound that is None isn't tested.

    ``words`` are those that the rule's ratio counts. With ``scripts``, the rule holds for texts of
    which at least half of the words' characters belong to one of these.
    """

    ratio: str
    least: float | None = None
    most: float | None = None
    words: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()


#: Ratios over words, lines or characters; see ``ratios``.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0, scripts=SCRIPTS),
    Rule("symbols_per_word", None, 0.25),
    Rule("capitals_per_char", None, 0.5),
    Rule("stop_words_per_word", 0.02, None, tuple(dict.fromkeys(w for t in STOP_WORDS.values() for w in t.split())), SCRIPTS),
    Rule("dup_lines_per_line", None, 0.5),
    Rule("repeat_words_per_word", None, 0.3),
)


def _gap(starts: Column) -> Column:
    """Words covered by windows that begin at these ascending positions."""
    init = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, init, step, lambda a: a["n"])


def _listed(rules: tuple[Rule, ...]) -> tuple[list[str], list[str]]:
    """Words that any rule counts, as they are and capitalised, and scripts that any rule names."""
    words = dict.fromkeys(x for r in rules for w in r.words for x in (w, w.capitalize()))
    return list(words), list(dict.fromkeys(s for r in rules for s in r.scripts))


def measured(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, all columns of ``docs``, and ``q``, a struct of counts; by projections only."""
    # the input's columns as one, so that no name can meet one of ours
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__t"), words_of(F.col(text)).alias("__w"))
    words, scripts = _listed(rules)
    n = F.size("__w")
    # words by their hashes, a window by the hash over its eight
    df = df.withColumn("__g", F.when(n > WINDOW, F.transform("__w", lambda w: F.xxhash64(w))))
    g = F.col("__g")
    at = F.transform(F.slice(g, 1, F.size(g) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get(g, i + k) for k in range(1, WINDOW))))
    df = df.withColumn("__h", F.when(g.isNotNull(), at).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window: only the others are sorted
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    s = F.col("__s")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("__p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    foreign = "".join(rf"\p{{Is{x}}}" for x in scripts)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_gap(F.col("__p")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size(F.filter("__w", lambda w: w.isin(*words))) if words else F.lit(0)).cast("long").alias("n_stop_words"),
        F.char_length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        (F.char_length(F.regexp_replace("__t", f"[^{foreign}]+", "")) if scripts else F.lit(0)).cast("long").alias("n_in_scripts"),
    )
    # not deterministic for the optimizer, which would otherwise put this whole expression in place of
    # each of its fields that a later filter names, level by level
    return df.select("row", F.when(F.monotonically_increasing_id() >= 0, counts).alias("q"))


def ratios(q: Column) -> dict[str, Column]:
    words, lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    return {
        "mean_word_chars": q["word_chars"] / words,
        "symbols_per_word": q["n_symbols"] / words,
        "capitals_per_char": q["n_capitals"] / F.greatest(q["word_chars"], F.lit(1)),
        "stop_words_per_word": q["n_stop_words"] / words,
        "dup_lines_per_line": q["n_dup_lines"] / lines,
        "repeat_words_per_word": q["n_repeat_words"] / words,
    }


def verdict(q: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept): the rule table as one conjunction."""
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    kept, by = ~failed, ratios(q)
    for r in rules:
        fine = F.lit(True)
        if r.least is not None:
            fine = fine & (by[r.ratio] >= r.least)
        if r.most is not None:
            fine = fine & (by[r.ratio] <= r.most)
        kept = kept & (fine | (2 * q["n_in_scripts"] < q["word_chars"]) if r.scripts else fine)
    return failed, kept


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict for every document."""
    df = measured(docs.select("doc_id", "text"), rules=rules)
    q = F.col("q")
    failed, kept = verdict(q, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("row.doc_id", *(q[c].alias(c) for c in names), failed.alias("base_failed"), kept.alias("kept"), *(q[c].alias(c) for c in ("n_lines", "n_stop_words", "n_capitals", "n_in_scripts")))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    return measured(docs, rules=rules).where(verdict(F.col("q"), rules)[1]).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same counts and verdict, for the rules as they stand, in SQL."""
    words, scripts = _listed(RULES)
    listed = ", ".join(f"'{w}'" for w in words)
    ratio = {
        "mean_word_chars": "word_chars / words", "symbols_per_word": "n_symbols / words", "capitals_per_char": "n_capitals / greatest(word_chars, 1)", "stop_words_per_word": "n_stop_words / words",
        "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)", "repeat_words_per_word": "n_repeat_words / words",
    }
    tests = []
    for r in RULES:
        sides = [f"{ratio[r.ratio]} >= {r.least}"] * (r.least is not None) + [f"{ratio[r.ratio]} <= {r.most}"] * (r.most is not None)
        tests.append("(" + " and ".join(sides) + (" or 2 * n_in_scripts < word_chars" if r.scripts else "") + ")")
    return rf"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
c as (select doc_id, i, count(*) over (partition by doc_id, s) as n from g),
r as (select doc_id, count(distinct i + k) as n from c, range({WINDOW}) x(k) where n > 1 group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
q as (
    select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
        len(list_filter(ws, lambda x: x in ({listed})))::bigint as n_stop_words, len(regexp_extract_all(t, '\p{{Lu}}'))::bigint as n_capitals,
        len(regexp_extract_all(t, '[{"".join(rf"\p{{{x}}}" for x in scripts)}]'))::bigint as n_in_scripts, greatest(len(ws), 1) as words
    from w join l on l.doc_id = w.doc_id left join r on r.doc_id = w.doc_id),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from q)
select * exclude (words, base_failed), base_failed, not base_failed and {" and ".join(tests)} as kept from f
"""


ORACLE = _oracle()
