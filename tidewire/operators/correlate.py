"""Request and response pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import decoded, flagged
from ..sources.store import written
from .project import with_flow
from .select import BUCKET

TIMEOUT_S, TICK = 30.0, 1000


def dns_messages(packets: DataFrame) -> DataFrame:
    """DNS messages with direction, id and flow, from plain columns."""
    rows = decoded(with_flow(packets)).where(flagged("dns") & F.col("dns").isNotNull())
    return rows.select("capture_id", "number", "ts_us", "dns.qr", "dns.id", "src", "dst", "transport", "src_port", "dst_port")


def _ticked(rows: DataFrame, tick: int, bucket: int) -> DataFrame:
    """Adds the latest time of a tick before each message and with its own, and whether it is one.

    Every ``tick``-th message of a capture with a time is a tick. Messages are ranked in buckets
    of ``number``; what came before a bucket is one row a bucket: the count of messages, then the
    latest tick time.
    """
    within, captures = Window.partitionBy("capture_id", "_b").orderBy("number"), Window.partitionBy("capture_id").orderBy("_b")
    sizes = rows.groupBy("capture_id", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("capture_id", "_b", (F.sum("_n").over(captures) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(within)).join(before, ["capture_id", "_b"])
    nth = F.col("_before") + F.col("_rank")
    marked = ranked.withColumn("_tick", F.when(nth % tick == 0, F.col("ts_us"))).withColumn("_own", F.max("_tick").over(within))
    ticks = ranked.where((nth % tick == 0) & F.col("ts_us").isNotNull()).groupBy("capture_id", "_b").agg(F.max("ts_us").alias("_t"))
    carried = sizes.select("capture_id", "_b").join(ticks, ["capture_id", "_b"], "left").select("capture_id", "_b", F.max("_t").over(captures.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    out = marked.join(carried, ["capture_id", "_b"])
    with_own = F.greatest("_carried", "_own")
    return out.select(*rows.columns, F.greatest("_carried", F.max("_tick").over(within.rowsBetween(Window.unboundedPreceding, -1))).alias("tick_before"), with_own.alias("tick_with"), F.col("_tick").isNotNull().alias("is_tick"))


def _purged(waiting: Column, tick_time: Column, limit: int, nothing: Column) -> Column:
    """Nothing, where a tick since the query came shows that it has waited too long."""
    late = (tick_time - waiting["ts_us"] >= limit) & F.coalesce(tick_time > waiting["seen"], F.lit(True))
    return F.when(tick_time.isNotNull() & late, nothing).otherwise(waiting)


def dns_pairs(packets: DataFrame, tick: int = TICK, timeout_s: float = TIMEOUT_S, bucket: int = BUCKET) -> DataFrame:
    """``capture_id, query_number, response_number, rtt`` of answered queries.

    The key is the flow (turned round for responses) and the id. The first pending query of a
    key stands until a response takes it; later queries are dropped, as are later responses and
    negative times. At each ``tick``-th message, queries that have waited ``timeout_s`` go.

    A response leaves nothing pending, so a key falls into turns that each end with a response;
    and between two ticks only a turn's first query can matter. Messages are therefore ordered
    only within buckets of ``number``, cut to such queries and the responses after one, and put
    to their turns by the counts of responses before each bucket. What is then folded, turn by
    turn, has at most one query for each tick: a flow that holds most of a capture is never one
    group. The few columns that this needs are written first, as they are read several times.
    """
    rows = written(dns_messages(packets).where("qr is not null and id is not null").withColumn("_b", F.floor(F.col("number") / bucket)), "dns-messages")
    sizes = rows.groupBy("capture_id").agg(F.count("*").alias("n"), (F.max("_b") - F.min("_b")).alias("buckets"))
    most, spread = sizes.agg(F.max("n"), F.max("buckets")).first()
    if (most or 0) >= tick:
        rows = _ticked(rows, tick, bucket)
    else:  # no capture has a tick
        none = F.lit(None).cast("long")
        rows = rows.withColumns({"tick_before": none, "tick_with": none, "is_tick": F.lit(False)})
    rows = rows.where("ts_us is not null and src is not null and transport is not null")
    ask = F.col("qr") == 0
    end = lambda a, p: F.struct(F.col(a).alias("a"), F.col(p).alias("p"))
    key = ["capture_id", "transport", "id", "client", "server"]
    keyed = rows.select(
        "capture_id", "_b", "transport", "id", F.when(ask, end("src", "src_port")).otherwise(end("dst", "dst_port")).alias("client"), F.when(ask, end("dst", "dst_port")).otherwise(end("src", "src_port")).alias("server"),
        "number", ask.alias("ask"), "ts_us", "tick_before", "tick_with", "is_tick",
    )
    inside = Window.partitionBy(*key, "_b").orderBy("number")
    last_ask, last_tick = F.lag("ask").over(inside), F.lag("tick_with").over(inside)
    answers = F.sum((~F.col("ask")).cast("int")).over(inside)
    # the first query of a turn between two ticks, any tick and what follows it; every response that may end a turn
    first = last_ask.isNull() | ~last_ask | F.col("is_tick") | F.lag("is_tick").over(inside) | ~last_tick.eqNullSafe(F.col("tick_with"))
    numbered = keyed.withColumn("_answers", answers).withColumn("_keep", F.when(F.col("ask"), first).otherwise(F.coalesce(last_ask, F.lit(True))))
    kept = numbered.where("_keep")
    if spread:
        answered = numbered.groupBy(*key, "_b").agg(F.max("_answers").alias("_n"))
        before = answered.select(*key, "_b", (F.sum("_n").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_n")).alias("_turns"))
        kept = kept.join(before, [*key, "_b"])
    else:  # every capture is in one bucket
        kept = kept.withColumn("_turns", F.lit(0))
    return _folded(kept, key, int(timeout_s * 1e6))


def _folded(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Puts the kept messages to their turns and folds each."""
    turn = F.col("_turns") + F.col("_answers") - (~F.col("ask")).cast("int")
    message = F.struct("number", "ask", "ts_us", "tick_before", "tick_with", "is_tick")
    grouped = rows.select(*key, turn.alias("turn"), message.alias("m")).groupBy(*key, "turn").agg(F.array_sort(F.collect_list("m")).alias("m"))
    nothing = F.lit(None).cast("struct<number:bigint,ts_us:bigint,seen:bigint>")
    none_found = F.lit(None).cast("struct<query_number:bigint,response_number:bigint,rtt:double>")

    def step(state, m):
        waiting = state["waiting"]
        left = _purged(waiting, m["tick_with"], limit, nothing)
        rtt = (m["ts_us"] - left["ts_us"]) / 1e6
        pair = F.struct(left["number"].alias("query_number"), m["number"].alias("response_number"), rtt.alias("rtt"))
        kept = F.coalesce(_purged(waiting, m["tick_before"], limit, nothing), F.struct(m["number"].alias("number"), m["ts_us"].alias("ts_us"), m["tick_with"].alias("seen")))
        asked = F.when(m["is_tick"] & (m["ts_us"] - kept["ts_us"] >= limit), nothing).otherwise(kept)
        return F.struct(F.when(m["ask"], asked).otherwise(nothing).alias("waiting"), F.when(~m["ask"] & left.isNotNull() & (rtt >= 0), pair).otherwise(state["pair"]).alias("pair"))

    # a turn's one response is its last message
    ended = grouped.where(~F.element_at("m", -1)["ask"] & (F.size("m") > 1))
    folded = ended.select("capture_id", F.aggregate("m", F.struct(nothing.alias("waiting"), none_found.alias("pair")), step, lambda s: s["pair"]).alias("p")).where("p is not null")
    return folded.select("capture_id", "p.query_number", "p.response_number", "p.rtt")
