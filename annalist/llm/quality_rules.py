"""Quality rules by distribution divergence, in DataFrame expressions only.

Each text becomes two histograms: character classes, and the common words of its language. Both are compared with
references of the language by the Jensen-Shannon distance (base 2, from 0 to 1); a text over either limit is
rejected. Guards of a minimum length switch a test off where a histogram would be noise. References are the mean
histograms of the corpus by language (one pass, one row per language reaching the plan as a broadcast of checked
size); languages with fewer than ``min_documents`` documents use the reference of all languages.

A word is a maximal run of characters other than space and U+0009 to U+000D. The base counts and the base failure
are described at ``profile``.

Defined results: a null text counts as empty and fails the base; a null language is a language of its own;
an empty table gives an empty result; repeated rows give repeated results and count repeatedly in the
references; other columns, whatever their names, are kept by ``keep`` and ignored by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# fixed values: the most common words of the languages of the corpus
COMMON_WORDS = {
    "en": "the of and to in a is that for it".split(),
    "fr": "de la le les et des un une que en".split(),
    "de": "der die und in den von zu das mit sich".split(),
    "es": "de la que el en y los del las un".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    char_distance: float = 0.25
    min_chars: int = 200  # code points below which the character test is off
    word_distance: float = 0.25
    min_word_count: int = 100  # words below which the common-word test is off
    min_documents: int = 30  # below which a language has no reference of its own


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _once(value: Column) -> Column:
    """``value`` in a form that the optimiser neither copies into later projections nor evaluates twice."""
    return F.when(F.rand(0) < 2, value)


#: Words up to which a window's hash and its place fit one long without collisions that matter.
PACKED_WORDS = 1 << 16


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first one included.

    ``grams`` holds the windows' 64-bit hashes in order. A text whose hashes are all different is done. In others
    hash and place are sorted together, so that equal windows are neighbours: packed in one long, the place in as many
    low bits as the text needs, or as pairs in very long texts.
    """

    def covered(again: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    def packed(low: Column) -> Column:
        keys = F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        near = lambda s: F.filter(s, lambda x, k: _same(F.get(s, k - 1), x, low) | _same(F.get(s, k + 1), x, low))
        return covered(F.transform(_let(keys, near), lambda x: x.bitwiseAND(low).cast("int")))

    def pairs(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return covered(F.transform(F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)), lambda x: x["i"]))

    n = F.size(words)
    long = _let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), pairs)
    return F.when((n < 4) | (F.size(F.array_distinct(grams)) == n - 2), F.lit(0)).when(n <= PACKED_WORDS, _let(F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n)).cast("int")) - 1, packed)).otherwise(long).cast("long")


def _same(x: Column, y: Column, low: Column) -> Column:
    z = x.bitwiseXOR(y)
    return F.coalesce((z >= 0) & (z <= low), F.lit(False))


def _words_of(lang: Column) -> Column:
    out = F.array(*map(F.lit, COMMON_WORDS["en"]))
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def profile(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A struct ``_row`` of the columns of ``documents`` (so that no name of theirs clashes), the language ``_lang``, a struct
    ``_m`` of the base counts and a struct ``_h`` of both histograms' shares."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    documents = documents.select(row.alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    text, kept = F.col("_text"), [F.col("_row"), F.col("_lang")]
    # the text without plain letters is short, and most counts need only that
    rest, words = F.regexp_replace(text, "[a-z]+", ""), F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    a = documents.select(*kept, _once(words).alias("_w"), _once(rest).alias("_r"), F.length(text).cast("long").alias("_len"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_dup"))
    w, r, n = F.col("_w"), F.col("_r"), F.size("_w").cast("long")
    grams = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    letters = F.regexp_replace(r, r"[^\p{L}\p{M}]+", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")).cast("long")
    common = F.array(*((n - F.size(F.array_remove(w, F.element_at(_words_of(F.col("_lang")), F.lit(i + 1))))).cast("double") for i in range(10)))
    b = a.select(
        *kept, "_len", "_dup", "_w", _once(grams).alias("_g"), n.alias("_n"), _count(r, SPACE).alias("_space"), _count(r, SYMBOLS).alias("_sym"), upper.alias("_upper"),
        (F.col("_len") - F.length(r) + F.length(letters) - upper).cast("long").alias("_lower"), _count(r, "0123456789").alias("_digit"),
        _count(r, ".,;:!?'\"()-").alias("_stop"), _count(r, "@/\\=+_^~`[]{}").alias("_punct"), common.alias("_common"),
    )
    classes = [F.col(c).cast("double") for c in ("_lower", "_upper", "_digit", "_space", "_stop")] + [(F.col("_sym") + F.col("_punct")).cast("double")]
    classes.append(F.greatest(F.col("_len") - sum(classes[1:], classes[0]), F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    shares = lambda x, of: _let(F.greatest(of.cast("double"), F.lit(1.0)), lambda t: F.transform(x, lambda y: y / t))
    every_word = F.concat("_common", F.array(F.col("_n") - total(F.col("_common"))))
    return b.select(
        *kept,
        F.struct(F.col("_n").alias("n_words"), (F.col("_len") - F.col("_space")).alias("word_chars"), F.col("_sym").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"), _repeat_words(F.col("_w"), F.col("_g")).alias("n_repeat_words")).alias("_m"),
        F.struct(shares(F.array(*classes), F.col("_len")).alias("chars"), shares(every_word, F.col("_n")).alias("words")).alias("_h"),
    )


def references(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean histograms by language over the documents long enough, and those of all under the key null and all = true."""
    flat = profiled.where(F.col("_m.n_words") >= limits.min_words).select(
        "_lang", *(F.col("_h.chars")[i].alias(f"c{i}") for i in range(len(CLASSES))), *(F.col("_h.words")[i].alias(f"w{i}") for i in range(11))
    )
    means = [F.avg(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES))] + [F.avg(f"w{i}").alias(f"w{i}") for i in range(11)]
    return (
        flat.rollup("_lang")
        .agg(F.count(F.lit(1)).alias("_n"), F.grouping("_lang").alias("_all"), *means)
        .where((F.col("_n") >= limits.min_documents) | (F.col("_all") == 1))
        .select("_lang", (F.col("_all") == 1).alias("_all"), F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("_rc"), F.array(*(f"w{i}" for i in range(11))).alias("_rw"))
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the divergence, base 2) of two histograms that each sum to one."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


#: Rows of references that are still broadcast; more languages than that have their references joined by a shuffle.
BROADCAST_LANGUAGES = 5000


def judged(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The columns of ``profiled`` (a table that can be read twice), and a struct ``_v`` of both distances and the verdict.

    A reference is one row per language; while those are few they are broadcast, else joined by a shuffle.
    """
    found = references(profiled, limits)
    rows = found.limit(BROADCAST_LANGUAGES + 1).collect()
    if len(rows) <= BROADCAST_LANGUAGES:
        found = profiled.sparkSession.createDataFrame(rows, found.schema)
    own = found.where(~F.col("_all")).select(F.col("_lang").alias("_l"), F.col("_rc").alias("_oc"), F.col("_rw").alias("_ow"))
    every = found.where("_all").select("_rc", "_rw")  # one row
    own, every = (F.broadcast(own) if len(rows) <= BROADCAST_LANGUAGES else own), F.broadcast(every)
    matched = profiled.join(own, F.col("_lang").eqNullSafe(F.col("_l")), "left").join(every, F.lit(True), "left")
    own_words = F.coalesce(F.col("_lang").isin(*COMMON_WORDS), F.lit(False))
    chars, words = jensen_shannon(F.col("_h.chars"), F.coalesce("_oc", "_rc")), jensen_shannon(F.col("_h.words"), F.coalesce("_ow", "_rw"))
    out = matched.select(*profiled.columns, _once(chars).alias("_cd"), _once(words).alias("_wd"))
    n = F.col("_m.n_words")
    base = (n < limits.min_words) | (100 * F.col("_m.n_repeat_words") > limits.max_repeat_percent * n)
    far = ((F.col("_m.word_chars") >= limits.min_chars) & (F.col("_cd") > limits.char_distance)) | ((n >= limits.min_word_count) & own_words & (F.col("_wd") > limits.word_distance))
    verdict = F.struct(F.col("_cd").alias("char_distance"), F.col("_wd").alias("word_distance"), base.alias("base_failed"), (~base & ~F.coalesce(far, F.lit(False))).alias("kept"))
    return out.select(*profiled.columns, verdict.alias("_v"))


def judge(documents: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document its counts, distances and verdict. The profiles, without texts, are written once and read twice."""
    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_t"), F.col(f"`{lang_col}`").alias("_l"))
    profiled = written(profile(rows, "_t", "_l").withColumn("_row", F.struct(F.col("_row")[id_col].alias(id_col))), "profiles")
    return judged(profiled, limits).select("_row.*", "_m.*", "_v.base_failed", "_v.kept", "_v.char_distance", "_v.word_distance")


def keep(documents: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``documents`` that are kept, with their own columns, whatever their names."""
    profiled = written(profile(documents, text_col, lang_col), "profiles")
    return judged(profiled, limits).where("_v.kept").select("_row.*")
