"""Reply-ordered conversations without quotes, in DataFrame operations only.

A line's quote level is the number of ``>`` that it opens with. Neighbouring
quoted lines of one level are a passage. Passages, and their lines one by one,
are normalised (lower case, white space collapsed), hashed, and joined to what
messages of the same conversation say outside quotes: whole message, paragraphs,
lines. The original of a hash is the earliest turn that says it, so a hash
meets one row, however often it was said or quoted; it counts if that turn lies
before the quoting one. The parent of a message is the original of its
outermost linked quote, of whole passages before lines, of longer before
shorter.

Messages stand in reply order: threads by the turn of their root, and in a
thread by turn. Roots come from doubling the parent links. Places in a
conversation come from counts of key ranges and ranks in them, so a long
conversation is never gathered; the result has ``BLOCK`` messages in a row.

Defined results: null and empty texts are messages without content; a null
conversation id is a conversation of its own, null turns come first and neither
quote nor get quoted; a role that is null is ``unknown``; repeated rows stay, and
rows of one turn share their links; a message of quotes alone keeps an empty
content; an empty table gives no row; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.shared import column, cut

BLOCK = 32
#: A line's opening marks: each may follow one blank.
MARKS = r"^(?: ?>)+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digest_of(unit: Column) -> Column:
    """Two hashes of the normalised text; together 128 bits."""
    return F.struct(F.xxhash64(unit).alias("x"), F.xxhash64(F.reverse(unit), F.length(unit)).alias("y"))


def prepared(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(row, conv, turn, role, lines, body): the lines with level and content, and what stands outside quotes."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), " ", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("line")))
    out = conversations.select(F.monotonically_increasing_id().alias("row"), column(conv).alias("conv"), column(turn).cast("long").alias("turn"), F.coalesce(column(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("lines", F.when(F.col("text").contains(">"), lines))
    body = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    # Written once: quotes, originals and the result read it, and ``row`` must stay the same.
    return cut(out.withColumn("body", F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))).drop("text"))


def quotes(messages: DataFrame) -> DataFrame:
    """(row, conv, turn, level, whole, unit): quoted passages (whole) and their lines."""
    quoted = messages.filter(F.exists("lines", lambda x: x["level"] > 0)).select("row", "conv", "turn", F.posexplode("lines").alias("at", "part")).select("row", "conv", "turn", "at", "part.level", "part.line")
    by_row = W.partitionBy("row").orderBy("at")
    runs = quoted.withColumn("new", (F.coalesce(F.lag("level").over(by_row), F.lit(-1)) != F.col("level")).cast("int")).withColumn("run", F.sum("new").over(by_row)).filter("level > 0")
    whole = runs.groupBy("row", "conv", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("row", "conv", "turn", "level", F.lit(1).alias("whole"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("unit"))
    return whole.unionByName(runs.select("row", "conv", "turn", "level", F.lit(0).alias("whole"), F.col("line").alias("unit"))).withColumn("unit", normal(F.col("unit"))).filter("unit <> ''")


def originals(messages: DataFrame) -> DataFrame:
    """(conv, hash, first): the earliest turn that says a unit outside quotes."""
    units = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", r"\n")))
    said = messages.filter("turn IS NOT NULL").select("conv", "turn", F.explode(units).alias("unit")).withColumn("unit", normal(F.col("unit"))).filter("unit <> ''")
    return said.groupBy("conv", digest_of(F.col("unit")).alias("hash")).agg(F.min("turn").alias("first"))


def parents(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked) for the turns that quote an earlier one."""
    quoted = cut(quotes(messages).select("conv", "turn", "level", "whole", F.length("unit").alias("size"), digest_of(F.col("unit")).alias("hash")))
    if quoted.isEmpty():
        return messages.select("conv", "turn", F.col("turn").alias("parent"), F.lit(0).cast("long").alias("n_linked")).limit(0)
    linked = quoted.alias("q").join(cut(originals(messages)).alias("o"), F.col("q.conv").eqNullSafe(F.col("o.conv")) & (F.col("q.hash") == F.col("o.hash")) & (F.col("o.first") < F.col("q.turn")))
    best = F.max_by("o.first", F.struct(-F.col("level"), F.col("whole"), F.col("size"), F.col("o.first")))
    return linked.groupBy("q.conv", "q.turn").agg(best.alias("parent"), F.sum("whole").cast("long").alias("n_linked"))


def roots(links: DataFrame) -> DataFrame:
    """(conv, turn, root) for every turn with a parent: the pointers are doubled until none moves."""
    now = cut(links.select("conv", "turn", F.col("parent").alias("root")))
    while True:
        step = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("further"))
        after = cut(now.join(step, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left").select("conv", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, counted from 0 in each group by ``order``. Groups are split over ranges of keys: a rank within the range, and the rows of the group in earlier ranges."""
    placed = cut(rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy(group, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select(F.col(group).alias("g"), F.col("range").alias("r"), before.alias("before")))
    inside = placed.withColumn("rank", F.row_number().over(W.partitionBy(group, "range").orderBy(*order)) - 1)
    joined = inside.join(offsets, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return joined.withColumn("place", (F.col("rank") + F.col("before")).cast("long")).drop("g", "r", "range", "rank", "before")


def messages_in_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, turn, role, body, parent, root, n_linked): every message without its quotes, with its place in reply order."""
    ready = prepared(conversations, conv, turn, role, text)
    links = cut(parents(ready))
    base = ready.select("conv", "turn", "role", "body")
    if links.isEmpty():
        whole = base.withColumns({"parent": F.lit(None).cast("long"), "root": F.col("turn"), "n_linked": F.lit(0).cast("long")})
    else:
        r = roots(links).select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "root")
        found = cut(links.join(r, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2"))).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "root", "n_linked"))
        whole = base.join(found, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").select("conv", "turn", "role", "body", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    return ranked(whole, "conv", ["root", "turn", "role", "body"])


def formatted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each BLOCK messages of a conversation: conv, block, n_messages, n_linked and the chat, each message under a line with its role."""
    ordered = messages_in_order(conversations, conv, turn, role, text).withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"))
    packed = ordered.groupBy("conv", "block").agg(F.count("*").alias("n_messages"), F.sum("n_linked").cast("long").alias("n_linked"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return packed.select(F.col("conv").alias(conv), "block", "n_messages", "n_linked", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("chat"))


#: The same rows in DuckDB's SQL: units are joined by their text, and roots are the least turn of a chain of parents, which always lead back.
ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, conv_id AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
split AS (SELECT row, conv, turn, regexp_split_to_array(text, '\r?\n') AS lines FROM m WHERE contains(text, '>')),
l AS (SELECT row, conv, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
p AS (SELECT row, conv, turn, pos, length(replace(regexp_extract(line, '^( ?>)+'), ' ', '')) AS level, regexp_replace(line, '^( ?>)+ ?', '') AS line FROM l),
own AS (SELECT row, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '') AS body FROM p GROUP BY row),
said AS (SELECT m.row, conv, turn, role, trim(regexp_replace(coalesce(own.body, text), '^\s+|\s+$', '', 'g')) AS body FROM m LEFT JOIN own USING (row)),
stepped AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY row ORDER BY pos) IS DISTINCT FROM level THEN 1 ELSE 0 END AS new FROM p),
runs AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY pos) AS run FROM stepped),
q AS (SELECT conv, turn, level, 1 AS whole, string_agg(line, ' ' ORDER BY pos) AS unit FROM runs WHERE level > 0 GROUP BY row, conv, turn, level, run UNION ALL SELECT conv, turn, level, 0, line FROM runs WHERE level > 0),
quoted AS (SELECT conv, turn, level, whole, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM q),
u AS (SELECT conv, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n\s*\n'), regexp_split_to_array(body, '\n'))) AS unit FROM said WHERE turn IS NOT NULL),
first_said AS (SELECT conv, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit, min(turn) AS origin FROM u GROUP BY ALL),
link AS (SELECT q.conv, q.turn, arg_max(origin, struct_pack(a := -level, b := whole, c := length(q.unit), d := origin)) AS parent, sum(whole)::BIGINT AS n_linked
 FROM quoted AS q JOIN first_said AS f ON q.conv IS NOT DISTINCT FROM f.conv AND q.unit = f.unit AND q.unit <> '' AND origin < q.turn GROUP BY ALL),
chain AS (SELECT conv, turn, parent AS up FROM link UNION SELECT c.conv, c.turn, link.parent FROM chain AS c JOIN link ON c.conv IS NOT DISTINCT FROM link.conv AND c.up = link.turn),
top AS (SELECT conv, turn, min(up) AS root FROM chain GROUP BY ALL),
whole AS (SELECT s.conv, s.role, s.body, s.turn, coalesce(top.root, s.turn) AS root, coalesce(link.n_linked, 0) AS n_linked FROM said AS s LEFT JOIN link ON s.conv IS NOT DISTINCT FROM link.conv AND s.turn = link.turn LEFT JOIN top ON s.conv IS NOT DISTINCT FROM top.conv AND s.turn = top.turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY root NULLS FIRST, turn NULLS FIRST, role, body) - 1 AS place FROM whole)
SELECT conv AS conv_id, place // 32 AS block, count(*) AS n_messages, sum(n_linked)::BIGINT AS n_linked, string_agg('<|' || role || '|>' || chr(10) || body, chr(10) ORDER BY place) AS chat FROM placed GROUP BY 1, 2
"""
