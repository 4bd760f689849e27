"""Mixing sources to target weights that change over training.

Each source has a schedule, its weight at times from 0 to 1, straight lines between given points. The schedule's integral is the source's weight in the whole mix: targets are shares of all words by these weights, but no source goes
above `passes` times its words; what that leaves over is shared among the others by weight until none is above. A source's documents stand in an order of hashes, are passed through again and again until the target is met, and
the last one is cut there. A copy of a document begins where the source's cumulative demand, the integral up to a time, reaches the words before it: inverting the integral gives its time, its position in the training order. Copies
are sorted by position with a range partitioning, and numbered by words.

Targets come from sums over sources in the order of how soon they are full, positions and numbers from sums over ranges (operators.order), so that neither a large source nor many sources meet in one task.

Defined cases: sources stand in the order of their code points, null last, and take the schedules in turn. Null texts have no words; documents without words have no copies, and are in the result. Null ids are ids like others. Repeated
rows are rows of their own. Reruns agree: ties in every order are between rows of equal source, id and text. An empty table gives no rows. Columns with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._shared import hot_join, row_at, written
from skein.operators.order import running

#: Points (time, weight) of a schedule. Integrals are 1, 2 and 3: the first source of three fades, the second is steady, the third grows.
Schedule = list[tuple[float, float]]
SCHEDULES: list[Schedule] = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 1.5), (1.0, 4.5)]]
PASSES = 3
_UNITS = 1 << 20  # weights are whole numbers of 1/_UNITS, so that their sums don't depend on the order


def _areas(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(area before, time, weight, slope) at each point, the last one with the whole area."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in schedule) < 0 or not any(w for _, w in schedule):
        raise ValueError("a schedule has points from time 0 to 1, in order, with weights that are not negative and not all 0")
    out, area = [], 0.0
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        out.append((area, t, w, (v - w) / (u - t)))
        area += (u - t) * (w + v) / 2
    return [*out, (area, 1.0, schedule[-1][1], 0.0)]


def _schedules(schedules: list[Schedule], rank: Column) -> tuple[Column, Column]:
    """The integral, and its pieces, of the schedule that the source of a rank (from 1) has."""
    areas = [_areas(s) for s in schedules]
    piece = lambda p: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(p, ("area", "at", "weight", "slope"), strict=True)))
    turn = F.pmod(rank - 1, F.lit(len(schedules))).cast("int") + 1
    return F.element_at(F.array(*(F.lit(a[-1][0]) for a in areas)), turn), F.element_at(F.array(*(F.array(*map(piece, a[:-1])) for a in areas)), turn)


def words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; null has none. Each word becomes one letter, so that no more than a copy of the text is held."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("bigint")


def at_time(pieces: Column, total: Column, share: Column) -> Column:
    """The time at which a schedule's integral is this share of the whole."""
    area = share * total
    piece = F.element_at(F.filter(pieces, lambda p: p["area"] <= area), -1)
    weight, rest = piece["weight"], area - piece["area"]
    root = weight + F.sqrt(F.greatest(weight * weight + F.lit(2.0) * piece["slope"] * rest, F.lit(0.0)))  # 0 only where nothing is left to go
    return F.least(piece["at"] + F.coalesce(F.lit(2.0) * rest / F.nullif(root, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def targets(sources: DataFrame, schedules: list[Schedule] = SCHEDULES, passes: int = PASSES) -> DataFrame:
    """Rows of (source, source_size), unique by source, with rank, start (the words of the sources before), total (the schedule's integral), pieces and target."""
    ranked = running(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("bigint"), "stop": F.col("source_size")})
    total, pieces = _schedules(schedules, F.col("rank"))
    ranked = ranked.select("source", "source_size", "rank", (F.col("stop") - F.col("source_size")).alias("start"), total.alias("total"), pieces.alias("pieces"))
    ranked = ranked.withColumn("units", F.round(F.col("total") * _UNITS).cast("bigint"))
    soon = F.when(F.col("units") > 0, F.col("source_size") / F.col("units"))  # how soon a source is full; one without weight never is
    filled = running(ranked, [soon.asc_nulls_last(), F.col("rank")], {"full": passes * F.col("source_size"), "used": F.col("units"), "turn": F.lit(1).cast("bigint")})
    whole = F.broadcast(sources.agg(F.sum("source_size").alias("words")).join(F.broadcast(ranked.agg(F.sum("units").alias("all_units")))))  # one row
    filled = filled.join(whole).select(
        *ranked.columns, "turn", (F.col("words") - F.col("full") + passes * F.col("source_size")).cast("double").alias("open"), (F.col("all_units") - F.col("used") + F.col("units")).cast("double").alias("left")
    )
    cap = (passes * F.col("source_size")).cast("double")
    above = F.col("open") * F.col("units").cast("double") >= cap * F.col("left")
    filled = written(filled.withColumn("above", above), "mix-sources")
    first = F.broadcast(filled.where(~F.col("above")).agg(F.min("turn").alias("from_turn"), F.min_by(F.struct("open", "left"), "turn").alias("rest")))  # one row
    share = F.col("units").cast("double") * F.col("rest.open") / F.nullif(F.col("rest.left"), F.lit(0.0))
    target = F.when(F.col("from_turn").isNull() | (F.col("turn") < F.col("from_turn")), cap).otherwise(F.least(F.coalesce(share, F.lit(0.0)), cap))
    return filled.join(first).select("source", "source_size", "rank", "start", "total", "pieces", target.alias("target"))


def mix(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, passes: int = PASSES, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents, and the copies of them that the mix takes.

    Documents: docs without the text, with __row (their number), size, source_size and target. Copies: __row, pass (from 0), words (fewer than the document's only where the target ends), position (0 to 1) and first_word, the number of
    words of the mix before the copy; sorted by position.
    """
    made = ("__row", "size", "source_size", "target")
    rest = [c for c in docs.columns if c not in (text, *made)]
    rows = docs.select(
        F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in rest)).alias("__doc"),  # so that no name clashes
        words(F.col(f"`{text}`")).alias("size"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("__source"),
        F.col(f"`{source}`").isNull().alias("__none"),
        F.struct(F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).alias("h"), F.col(f"`{doc_id}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t")).alias("__order"),
    )
    rows = written(row_at(rows, "__row"), "mix-rows")
    counts = written(rows.groupBy("__source", "__none").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sizes")
    wanted = targets(counts.select(F.when(~F.col("__none"), F.col("__source")).alias("source"), "source_size"), schedules, passes)
    wanted = wanted.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), "rank", "start", "total", "pieces", "target", "source_size")
    wanted = wanted.join(counts.select("__source", "__none", "n"), ["__source", "__none"])
    rows = hot_join(rows, wanted, ["__source", "__none"], rows.count()).drop("n", "__source", "__none")
    placed = running(rows, [F.col("rank"), F.col("__order.h"), F.col("__order.id").asc_nulls_last(), F.col("__order.t"), F.col("__row")], {"__end": F.col("size")})
    placed = written(placed.withColumn("__before", F.col("__end") - F.col("size") - F.col("start")).drop("__end", "start"), "mix-placed")
    goal = F.least(F.floor(F.col("target") + 0.5).cast("bigint"), passes * F.col("source_size"))
    begins = F.col("pass") * F.col("source_size") + F.col("__before")
    copies = placed.where("size > 0").withColumn("__goal", goal).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.withColumn("words", F.least(F.col("size"), F.col("__goal") - begins)).where("words > 0")
    copies = copies.select("__row", "pass", "words", at_time(F.col("pieces"), F.col("total"), begins.cast("double") / F.col("__goal")).alias("position"), "rank", begins.alias("__begins"))
    stream = running(copies, [F.col("position"), F.col("rank"), F.col("__begins")], {"__stop": F.col("words")})
    return placed.select(*(F.col("__doc")[c].alias(c) for c in rest), *made), stream.select("__row", "pass", "words", "position", (F.col("__stop") - F.col("words")).alias("first_word"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and first_word, the words of the mix before the document's first copy (null if it has none)."""
    rows, copies = mix(docs.select("doc_id", "text", "source"))
    taken = copies.groupBy("__row").agg(F.sum("words").alias("taken"), F.min("first_word").alias("first_word"))  # at most PASSES copies of a row
    return rows.join(taken, "__row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_word")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS t FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM docs GROUP BY source
), weights AS (
  SELECT *, CAST(1 + (rank - 1) % 3 AS DOUBLE) AS w, CASE (rank - 1) % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 1.5 END :: DOUBLE AS w0, CASE (rank - 1) % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 0.0 ELSE 3.0 END :: DOUBLE AS slope FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS turn, CAST((SELECT sum(source_size) FROM sources) - sum(3 * source_size) OVER o + 3 * source_size AS DOUBLE) AS open, (SELECT sum(w) FROM weights) - sum(w) OVER o + w AS remains
  FROM weights WINDOW o AS (ORDER BY source_size / w, rank ROWS UNBOUNDED PRECEDING)
), first AS (
  SELECT turn, open, remains FROM ordered WHERE open * w < 3.0 * source_size * remains ORDER BY turn LIMIT 1
), wanted AS (
  SELECT o.source, source_size, rank, w, w0, slope, CASE WHEN f.turn IS NULL OR o.turn < f.turn THEN 3.0 * source_size ELSE least(w * f.open / f.remains, 3.0 * source_size) END :: DOUBLE AS target FROM ordered o LEFT JOIN first f ON true
), placed AS (
  SELECT row_number() OVER () AS id, doc_id, size, source_size, rank, w, w0, slope, target, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS goal,
    sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id NULLS LAST, t ROWS UNBOUNDED PRECEDING) - size AS before
  FROM docs JOIN wanted ON docs.source IS NOT DISTINCT FROM wanted.source
), copies AS (
  SELECT *, p * source_size + before AS begins, least(size, goal - p * source_size - before) AS words FROM placed, unnest(range(0, 3)) AS u(p)
), timed AS (
  SELECT *, least(CASE WHEN w0 = 0 THEN 0.0 ELSE 2.0 * (CAST(begins AS DOUBLE) / goal * w) / (w0 + sqrt(w0 * w0 + 2.0 * slope * (CAST(begins AS DOUBLE) / goal * w))) END, 1.0) AS position FROM copies WHERE size > 0 AND words > 0
), stream AS (
  SELECT id, words, sum(words) OVER (ORDER BY position, rank, begins ROWS UNBOUNDED PRECEDING) - words AS first_word FROM timed
), taken AS (SELECT id, sum(words) AS taken, min(first_word) AS first_word FROM stream GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_word AS BIGINT) AS first_word FROM placed LEFT JOIN taken USING (id)
"""
