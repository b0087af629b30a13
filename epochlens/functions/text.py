"""Tokens, stems, phrases, query terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters and numbers of any script.
TOKEN = r"[\p{L}\p{N}]+"
#: Texts that are stemmed at once, and words whose stems a task remembers.
TEXTS, STEMS_KEPT = 1000, 1_000_000


def _folding() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that decompose to one letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case without diacritics; ligatures and wide forms stay as they are."""
    accented, plain = _folding()
    marks = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\p{Mn}+", "")
    return F.lower(F.translate(marks, accented, plain))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def token_text(c: Column) -> Column:
    """tokens() as one text with single blanks between."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))


_VOWELS = "aeiou"
# Suffixes of the Porter algorithm with what replaces them, by step.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log", "bli": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in _VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The Porter stem of a lower-case word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, _STEP4)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)][-1:] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_word(c: Column) -> Column:
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(porter)

    return stems(c)


def normalized(term: str) -> str:
    """Compatibility form, trimmed, single spaces, lower case (not case-folded)."""
    return " ".join(unicodedata.normalize("NFKC", term).split()).lower()


def normalize_term(c: Column) -> Column:
    @F.pandas_udf("string")
    def normal(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else normalized(t))

    return normal(c)


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their lists of tokens as lists of stems."""
    known: dict[str, str] = {}
    for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
        lists = batch.column("toks")
        words = pc.dictionary_encode(lists.flatten())
        if len(known) > STEMS_KEPT:
            known.clear()
        stems = [known.get(w) or known.setdefault(w, porter(w)) for w in words.dictionary.to_pylist()]
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        toks = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(stems, pa.string()).take(words.indices))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("field"), toks], ["id", "field", "toks"])


def tokenized(df: DataFrame, id_col: str, fields: list[str], stem: bool = True) -> DataFrame:
    """(id, field, toks): the tokens of each field as one text with a blank around each.

    Stems are found where the tokens are, batch by batch, each distinct word of a batch looked up once and stemmed once a
    task while it is remembered; so no token is shuffled. Rows that repeat an id stay apart.
    """
    cols = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("toks")) for f in fields])
    long = df.select(F.col(id_col).alias("id"), F.explode(cols).alias("x")).select("id", "x.field", "x.toks")
    if stem:
        kind = long.schema["id"].dataType.simpleString()
        long = long.mapInArrow(_stemmed, f"id {kind}, field string, toks array<string>")
    return long.where(F.size("toks") > 0).select("id", "field", F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" ")).alias("toks"))


def phrase_tokens(terms: DataFrame, stem: bool = True) -> DataFrame:
    """terms with phrase, like toks of tokenized(), and its first token; terms without a token go."""
    t = terms.withColumn("__t", tokens(F.col("normalized"))).where(F.size("__t") > 0)
    if stem:
        @F.pandas_udf("array<string>")
        def stems(lists: pd.Series) -> pd.Series:
            return lists.map(lambda x: [porter(w) for w in x])

        t = t.withColumn("__t", stems("__t"))
    return t.withColumn("phrase", F.concat(F.lit(" "), F.array_join("__t", " "), F.lit(" "))).withColumn("first_token", F.col("__t")[0]).drop("__t")


def phrase_matches(tokenized_df: DataFrame, terms: DataFrame, field: str | None = None) -> DataFrame:
    """Distinct (query_id, id) where the phrase lies within one field.

    Rows meet the phrases whose first token they hold, whatever the number of terms: an equi-join on tokens, without
    texts. Then each row that holds one is compared with its phrases, once.
    """
    docs = tokenized_df if field is None else tokenized_df.where(F.col("field") == field)
    wanted = terms.select("query_id", "phrase", "first_token").groupBy("first_token").agg(F.collect_list(F.struct("query_id", "phrase")).alias("phrases"))
    posts = docs.select("id", "field", F.explode(F.array_distinct(F.split(F.trim("toks"), " "))).alias("first_token"))
    held = posts.join(wanted, "first_token").select("id", "field", F.explode("phrases").alias("p")).groupBy("id", "field").agg(F.collect_list("p").alias("ps"))
    hit = docs.join(held, ["id", "field"]).select("id", F.explode(F.filter("ps", lambda p: F.contains(F.col("toks"), p["phrase"]))["query_id"]).alias("query_id"))
    return hit.select("query_id", "id").distinct()


#: A part of a field: what is between two quotes, in which two quotes stand for one, or a run without quotes.
FIELD_PART = r'"(?:[^"]|"")*"|[^"]+'
#: A comma that an even number of quotes precedes, where their whole number is even.
FIELD_END = r',(?=[^"]*(?:"[^"]*"[^"]*)*$)'


def query_labels(query: Column) -> Column:
    """The trimmed fields of a query text: commas outside double quotes end them, and a doubled quote inside is one quote."""
    def plain(part: Column) -> Column:
        return F.when(part.startswith('"'), F.replace(F.substring(part, F.lit(2), F.length(part) - 2), F.lit('""'), F.lit('"'))).otherwise(part)

    parts = lambda field: F.regexp_extract_all(field, F.lit(FIELD_PART), F.lit(0))
    label = lambda field: F.array_join(F.transform(parts(field), plain), "")
    return F.transform(F.split(query, FIELD_END), lambda field: F.regexp_replace(label(field), r"(?U)^\s+|\s+$", ""))


def split_query_terms(queries: DataFrame, query_col: str = "query", most: int | None = 5, longest: int = 500) -> DataFrame:
    """(query, ord, query_id, label, normalized, error): the terms of each query text, equal ones once, first seen first.

    A text that can't be split gives one row with the reason in error; a null one counts as empty. Fields and errors
    are column expressions; Python only gives terms their compatibility form.
    """
    @F.pandas_udf("array<string>")
    def all_normalized(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [normalized(x) for x in xs])

    d = queries.select(F.col(query_col).alias("query")).withColumn("__q", F.coalesce("query", F.lit("")))
    shape = F.when(F.length("__q") > longest, "query is too long").when(F.length(F.regexp_replace("__q", '[^"]', "")) % 2 == 1, "unmatched quote")
    d = d.withColumn("__e", shape).withColumn("__l", F.when(F.col("__e").isNull(), query_labels(F.col("__q"))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__n", all_normalized("__l"))
    several = F.lit(False) if most is None else F.size(F.array_distinct("__n")) > most
    error = F.coalesce("__e", F.when(F.array_contains("__n", ""), "empty term").when(several, "too many terms"))
    found = F.filter(F.arrays_zip(F.col("__l").alias("label"), F.col("__n").alias("normalized")), lambda t, i: F.array_position("__n", t["normalized"]) == i + 1)
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("normalized")))
    d = d.select("query", error.alias("error"), F.posexplode(F.when(error.isNull(), found).otherwise(nothing)).alias("ord", "t"))
    named = F.concat(F.lit("q-"), F.substring(F.sha2("t.normalized", 256), 1, 12))
    return d.select("query", "ord", named.alias("query_id"), "t.label", "t.normalized", "error")


def series_key(parameters: dict[str, Column]) -> Column:
    """A digest of named parameters, whatever their order; the key of a stored series."""
    return F.sha2(F.to_json(F.struct(*[parameters[k].alias(k) for k in sorted(parameters)]), {"ignoreNullFields": "false"}), 256)
