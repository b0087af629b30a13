"""Drop lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.base import bound
from epochlens.llm.common import cut, if_small, unused

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case and other letters as they are."""
    # of ASCII alone lower() is the same, and quicker
    ascii_lower = lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))
    return bound(F.btrim(line, F.lit(BLANKS)), ascii_lower)


def dropped_positions(docs: DataFrame, least_docs: int, least_chars: int, text_col: str) -> DataFrame:
    """(digest, dropped): for each text with lines to drop, by its sha-256, the positions of these lines from 0 on.

    Lines are hashed once, into a table of texts' digests and line hashes by position; a hash is counted once a
    document, with partial counts before the shuffle; the hashes at or over the threshold are joined to the positions,
    broadcast while small and shuffled beyond, where a hash that most documents hold is split by the skew join.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    one = lambda line: bound(line_key(line), lambda key: F.when(F.length(key) >= least_chars, F.md5(key)))
    hashed = cut(docs.select(F.sha2(text, 256).alias("digest"), F.transform(F.split(text, "\n", -1), one).alias("hashes")), "line-hashes")
    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash is not null")
    frequent = cut(each.groupBy("hash").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("hash"), "line-frequent")
    lines = hashed.select("digest", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    return lines.join(if_small(frequent), "hash", "left_semi").groupBy("digest").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, text_col: str = "text") -> DataFrame:
    """docs with text less its lines that are found in least_docs documents or more, and with n_lines and n_dropped.

    Texts are split at newlines; lines are the same if their keys are: blanks at both ends stripped, A-Z in lower case.
    Lines whose key has fewer than least_chars characters always stay. Every occurrence of a shared line goes, from all
    documents; the others stay in order and as they are, joined by newlines; a text of which nothing stays is empty.

    A null or empty text is one empty line and becomes empty. Each row is a document: rows that repeat an id or a text count
    one by one, and equal texts lose the same lines. A line counts once a document however often it repeats there. Long
    texts are one row of hashes. Columns n_lines and n_dropped are replaced, others stay. Empty tables stay empty.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = cut(dropped_positions(docs, least_docs, least_chars, text_col), "line-drops")
    mark, gone = unused(docs, "line_digest"), unused(docs, "line_dropped")
    drops = if_small(drops).withColumnsRenamed({"digest": mark, "dropped": gone})
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.withColumn(mark, F.sha2(text, 256)).join(drops, mark, "left")
    text = F.coalesce(d[text_col].cast("string"), F.lit(""))

    def less(lines: Column) -> Column:
        # positions to drop become stretches between them, so that a text of very many lines takes one pass
        ends = F.array_sort(F.concat(d[gone], F.array(F.lit(-1), F.size(lines))))
        between = lambda at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.slice(lines, F.get(at, i - 1) + 2, F.get(at, i) - F.get(at, i - 1) - 1))
        kept = F.when(d[gone].isNull(), text).otherwise(F.array_join(F.flatten(bound(ends, between)), "\n"))
        return F.struct(kept.alias("text"), F.size(lines).cast("long").alias("n"))

    made = unused(docs, "line_made")
    d = d.withColumn(made, bound(F.split(text, "\n", -1), less))
    return d.select(*[d[made]["text"].alias(c) if c == text_col else d[c] for c in docs.columns], d[made]["n"].alias("n_lines"), F.coalesce(F.size(d[gone]), F.lit(0)).cast("long").alias("n_dropped"))


LINES_SQL = r"""
with t as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
x as (select r, unnest(ls) line, generate_subscripts(ls, 1) pos from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from x),
f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10),
j as (select k.r, k.pos, k.line, f.key is not null gone from k left join f on k.key = f.key),
d as (select r, count(*) n_lines, count(*) filter (gone) n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') kept from j group by r)
select doc_id, n_lines::bigint n_lines, n_dropped::bigint n_dropped, sha256(kept) kept_sha256 from d join t using (r)
"""
