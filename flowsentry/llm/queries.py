"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm.decontaminate import find_hits
from flowsentry.llm.fingerprints import fingerprints
from flowsentry.llm.htmlblocks import extract
from flowsentry.llm.licences import scan
from flowsentry.llm.lmscore import lm_scores
from flowsentry.llm.nearcopies import near_copies
from flowsentry.llm.packing import pack
from flowsentry.llm.periodicity import periodic_runs, planted, run_digests
from flowsentry.llm.quality import fit_quality, score_quality
from flowsentry.llm.sharding import shard
from flowsentry.llm.spelling import spelling_variants
from flowsentry.llm.toxicity import fit_toxicity, score_toxicity
from flowsentry.llm.urltrust import Rule, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
TOKENIZER = "word_bpe_49k.json"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learnt from the labelled rows that aren't held out."""
    docs = read(spark, folder, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, folder, "labels")))


@query
def op2_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The near-copy class of every document."""
    return near_copies(read(spark, folder, "documents"))


@query
def op3_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url: the rules', else that of trust and distrust along links between hosts."""
    return judge(read(spark, folder, "pages"), RULES)


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, folder, "pages"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in packed sequences, mixed by source."""
    return pack(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that benchmark windows cover, and the items they come from."""
    found = find_hits(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["past"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 16 with nearly equal sizes, and its slot there."""
    return shard(read(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document, learnt from labelled rows that aren't held out."""
    docs = read(spark, folder, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, folder, "labels")))


@query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The phrase fingerprint of every document and of its edited text, and how alike they are."""
    return fingerprints(read(spark, folder, "documents"))


@query
def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """The licence of every document, its own or its directory's; source and language are the directories."""
    docs = read(spark, folder, "documents")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")]
    found = scan(docs.select(F.concat_ws("/", *parts).alias("path"), "text"))
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("bigint"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents with the more frequent spelling that each may be meant for."""
    return spelling_variants(read(spark, folder, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, after a periodic ending was planted in a tenth of them."""
    return run_digests(periodic_runs(read(spark, folder, "documents"), change=planted))


@query
def op13_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of every document after the training documents, by counts and by context mixing."""
    return lm_scores(read(spark, folder, "documents"))


_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLES["op6_decontamination"] = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM s),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM p),
h AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS hex
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(hex, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

# crc32 byte by byte: a table of 256 remainders, then one step for each byte of the UTF-8 text (at most two a letter).
ORACLES["op11_spelling_variants"] = """WITH RECURSIVE
t AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM b, t),
m AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b, y.n AS n FROM s x JOIN s y ON x.i = y.i AND x.short = y.short AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM s x JOIN w y ON x.short = y.word
  UNION SELECT y.word, x.word, x.n FROM s x JOIN w y ON x.short = y.word),
q AS (SELECT a, count(*) AS n_near, max(n) AS top, arg_min(b, (-n, b)) AS best FROM p GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN best END AS form,
  CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN q ON q.a = w.word),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""
