"""A versioned tree of the documents, and recurring runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedule
from ..sources.tree import Tree
from .change_capture import NEW_SQL, OLD_SQL, old_and_new
from .registry import query, table


def _files(docs):
    return docs.filter("doc_id is not null").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, a AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM old),
    b AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM new),
    s AS (SELECT 1 AS ref, path, content, 1 AS c FROM a UNION ALL SELECT 2, b.path, b.content, CASE WHEN a.content = b.content THEN 1 ELSE 2 END FROM b LEFT JOIN a USING (path)),
    t AS (SELECT * FROM s UNION ALL SELECT 3, CASE WHEN starts_with(path, 'src0/') THEN '_repealed/' || path ELSE path END, content, CASE WHEN starts_with(path, 'src0/') THEN 3 ELSE c END FROM s WHERE ref = 2)
    SELECT CAST(ref AS INTEGER) AS ref, path, sha256(content) AS content_hash, CAST(c AS BIGINT) AS "commit" FROM t""")
def tree_at_ref(spark, d):
    """The state of a tree after an import, an update with deletions, and a moved directory."""
    tree = Tree(spark)
    old, new = (_files(x) for x in old_and_new(spark, d))
    tree.commit(old, "import")
    gone = old.join(new, "path", "left_anti").select("path", F.lit(None).cast("string").alias("content"))
    tree.commit(new.unionByName(gone), "update")
    tree.compact(2)
    tree.move_directory("src0", "_repealed/src0", "repeal")
    states = [tree.at(ref, content=False).select(F.lit(ref).alias("ref"), "path", "content_hash", "commit") for ref in (1, 2, 3)]
    return states[0].unionByName(states[1]).unionByName(states[2])


LINES = ("0 3 * * *", "0 15 * * *", "*/15 * * * *", "30 2 * * 0", "0 0 1 * *")


@query("""WITH e AS (SELECT event_id, ts, date_trunc('minute', ts) AS m, event_id % 5 AS n FROM events WHERE ts IS NOT NULL), z AS (SELECT *, epoch(ts) AS s FROM e)
    SELECT event_id, CASE n WHEN 0 THEN '0 3 * * *' WHEN 1 THEN '0 15 * * *' WHEN 2 THEN '*/15 * * * *' WHEN 3 THEN '30 2 * * 0' ELSE '0 0 1 * *' END AS line,
        CAST(epoch(CASE n WHEN 0 THEN date_trunc('day', ts) + CASE WHEN ts < date_trunc('day', ts) + INTERVAL 3 HOUR THEN INTERVAL 3 HOUR ELSE INTERVAL 27 HOUR END
            WHEN 1 THEN date_trunc('day', ts) + CASE WHEN ts < date_trunc('day', ts) + INTERVAL 15 HOUR THEN INTERVAL 15 HOUR ELSE INTERVAL 39 HOUR END
            WHEN 2 THEN time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE
            WHEN 3 THEN CASE WHEN isodow(ts) = 7 AND ts < date_trunc('day', ts) + INTERVAL 150 MINUTE THEN date_trunc('day', ts) + INTERVAL 150 MINUTE ELSE date_trunc('week', ts) + INTERVAL 8790 MINUTE
                + CASE WHEN isodow(ts) = 7 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END END
            ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END) AS BIGINT) AS next_unix FROM z""")
def schedule_next_run(spark, d):
    """The next run of a recurring job after each event, in UTC; zones are covered by tests."""
    line = F.get(F.array(*map(F.lit, LINES)), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, d, "events").filter("ts is not null").select("event_id", line.alias("line"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return rows.select("event_id", "line", schedule.next_runs(F.col("line"), F.lit("UTC"), F.col("at")).alias("next_unix"))
