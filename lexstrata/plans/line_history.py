"""Edit scripts, hunks and provenance of the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import line_diff
from .change_capture import NEW_SQL, OLD_SQL, old_and_new
from .registry import query, table


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT doc_id, sha256(old.text) AS old_sha, sha256(new.text) AS new_sha,
    CASE WHEN old.text IS NULL THEN len(string_split(new.text, chr(10))) WHEN new.text IS NULL THEN len(string_split(old.text, chr(10))) END AS changes_of_one_side
    FROM old FULL JOIN new USING (doc_id) WHERE old.text IS DISTINCT FROM new.text""")
def line_diff_replay(spark, d):
    """Both texts of each changed document, put together again from its edit script."""
    script = line_diff.edit_script(*old_and_new(spark, d), "doc_id", "text")
    counted = script.groupBy("doc_id").agg(F.count_if(F.col("op") != "=").alias("n"))
    rows = line_diff.replayed(script, "doc_id").join(counted, "doc_id")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    one_side = F.when(F.col("old").isNull() | F.col("new").isNull(), F.col("n"))
    return rows.select("doc_id", sha("old").alias("old_sha"), sha("new").alias("new_sha"), one_side.alias("changes_of_one_side"))


@query()
def line_diff_hunks(spark, d):
    """Unified hunks of each changed document."""
    return line_diff.hunks(line_diff.edit_script(*old_and_new(spark, d), "doc_id", "text"), "doc_id")


def document_versions(docs):
    """Four versions a document, a sentence a line: as it is, without every fifth line, its
    halves changed over, and as it was."""
    whole = F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n", -1)
    thinned = F.filter("whole", lambda _, i: i % 5 != F.pmod("doc_id", F.lit(5)))
    half = F.expr("size(thin) div 2")
    turned = F.concat(F.slice("thin", half + 1, F.size("thin")), F.slice("thin", F.lit(1), half))
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", whole.alias("whole")).withColumn("thin", thinned)
    each = F.posexplode(F.array(F.col("whole"), F.col("thin"), turned, F.col("whole"))).alias("version", "lines")
    return rows.select("doc_id", each).select("doc_id", (F.col("version") + 1).alias("version"), F.array_join("lines", "\n").alias("text"))


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS whole FROM documents WHERE text IS NOT NULL),
    t AS (SELECT *, len(list_filter(range(len(whole)), lambda i: i % 5 <> doc_id % 5)) AS n FROM l)
    SELECT doc_id, len(whole) AS lines, sha256(array_to_string(whole, chr(10))) AS text_sha,
        CASE WHEN n % 2 = 1 AND len(list_distinct(whole)) = len(whole) THEN (n + 1) // 2 END AS since_first,
        CASE WHEN n % 2 = 1 AND len(list_distinct(whole)) = len(whole) THEN len(whole) - (n + 1) // 2 END AS since_last FROM t""")
def line_provenance(spark, d):
    """Each line's origin after a deletion, a move and a revert, counted.

    Where all lines differ and the halves that change places are uneven, the larger half stays
    since the first version, and all other lines of the last one came back in it.
    """
    docs = table(spark, d, "documents").filter("text is not null")
    found = line_diff.provenance(document_versions(docs), "doc_id", "text", "version")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    per_doc = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sha2(text.cast("binary"), 256).alias("text_sha"), F.countDistinct("line").alias("different"),
        F.count_if(F.col("origin") == 1).alias("first"), F.count_if(F.col("origin") == 4).alias("last"), F.count_if(F.pmod(F.col("line_no") - 1, F.lit(5)) != F.pmod("doc_id", F.lit(5))).alias("thin"),
    )
    sure = (F.col("different") == F.col("lines")) & (F.col("thin") % 2 == 1)
    return per_doc.select("doc_id", "lines", "text_sha", F.when(sure, F.col("first")).alias("since_first"), F.when(sure, F.col("last")).alias("since_last"))
