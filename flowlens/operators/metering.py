"""Packets to bidirectional flows.

A flow is a run of packets between two endpoints (both directions, one protocol). It ends after more than
``idle`` of silence, or when a packet comes more than ``active`` after its first one; that packet starts
the next flow. Times are whole milliseconds.

One endpoint pair may hold a large part of all packets, so no step sorts a whole pair in one task:

1. packets of one pair in the same millisecond are merged, partially before the shuffle;
2. merged rows are sorted per pair and time slice (at most one row per millisecond of the slice) and summed
   up to one row per slice. A slice is no longer than ``idle``, so no session ends inside one: sessions,
   and their sums, follow from the slices alone;
3. only sessions longer than ``active`` go back to their packets. Those of at most ``CHASE_ROWS`` packets are cut
   by one pass over their times. Larger ones follow "first packet more than ``active`` later" pointers, which are
   doubled block by block: a session of n flows takes log2(n) joins, and each doubling keeps only the packets that
   can open a block, which halves the rows.

Sums of squares are whole numbers, so deviations lose no digits and do not depend on the order of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalar import flow_id, per_second
from flowlens.schemas import FLOWS
from flowlens.session import written

IDLE_S = 120
ACTIVE_S = 1800
SLICE_S = 3600
FEW_SESSIONS = 100_000
#: Packets of a session whose times one task passes over; larger sessions are cut by pointers.
CHASE_ROWS = 100_000
PAIR = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
FLAGS = ["syn", "ack", "psh", "rst", "fin"]


def with_pair(packets: DataFrame) -> DataFrame:
    """Both directions get the same pair: the smaller endpoint is ``a``. ``forward`` tells a to b.

    Addresses, ports, times and sizes take the table's defaults ('' and 0) for NULL: the pair is a plain key, and both
    the batch and the stream count a packet without a size as one of 0 bytes.
    """
    known = {"src_ip": "", "dst_ip": "", "src_port": 0, "dst_port": 0, "protocol": 0, "size": 0}
    packets = packets.withColumns({
        c: F.coalesce(F.col(c), F.lit(default).cast(packets.schema[c].dataType)) for c, default in known.items()
    })
    forward = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port"))
    )

    def pick(one: str, other: str) -> Column:
        return F.when(F.col("_forward"), F.col(one)).otherwise(F.col(other))

    return packets.withColumn("_forward", forward).select(
        pick("src_ip", "dst_ip").alias("ip_a"),
        pick("src_port", "dst_port").alias("port_a"),
        pick("dst_ip", "src_ip").alias("ip_b"),
        pick("dst_port", "src_port").alias("port_b"),
        "protocol",
        F.col("_forward").alias("forward"),
        F.coalesce(F.unix_millis("ts"), F.lit(0)).cast("bigint").alias("t"),
        "seq", "ip_version", "size", *FLAGS,
    )


def _bucket(x: Column, width: int) -> Column:
    """The beginning of the bucket of ``width`` that holds ``x``."""
    return x - F.pmod(x, F.lit(width).cast("bigint"))


def _square(x: Column) -> Column:
    """The square of a whole number, exactly."""
    return x.cast("decimal(19,0)") * x.cast("decimal(19,0)")


def merge_instants(pairs: DataFrame, slice_ms: int) -> DataFrame:
    """One row per pair and millisecond, with the sums a flow needs."""
    return pairs.groupBy(*PAIR, _bucket(F.col("t"), slice_ms).alias("slice"), "t").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("bytes"),
        F.sum(_square(F.col("size"))).alias("square"),
        F.min("size").alias("smallest"),
        F.max("size").alias("largest"),
        F.count_if("forward").alias("forward_n"),
        F.sum(F.when(F.col("forward"), F.col("size")).otherwise(0)).alias("forward_bytes"),
        F.min_by("forward", "seq").alias("first_forward"),
        F.min("ip_version").alias("ip_version"),
        *[F.count_if(f).alias(f) for f in FLAGS],
    )


def with_previous(rows: DataFrame) -> DataFrame:
    """Add ``prev``, the previous time of the pair inside the slice."""
    return rows.withColumn("prev", F.lag("t").over(Window.partitionBy(*PAIR, "slice").orderBy("t")))


def pieces(rows: DataFrame) -> DataFrame:
    """Merged rows as pieces of a flow: first and last time, the gaps inside, and the gap that leads to it.

    Packets in the same millisecond follow each other with gap 0.
    """
    inside = F.when(F.col("n") > 1, F.lit(0).cast("bigint"))
    return rows.withColumns({
        "first": F.col("t"), "last": F.col("t"), "least_gap": inside, "most_gap": inside,
        "gap_square": F.lit(0).cast("decimal(38,0)"), "lead": F.col("t") - F.col("prev"),
    })


def combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Put consecutive pieces together, per slice or per flow; merges partially before a shuffle."""
    lead = F.col("lead")
    return parts.groupBy(*keys).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.sum("square").alias("square"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.sum("forward_n").alias("forward_n"),
        F.sum("forward_bytes").alias("forward_bytes"),
        # One number, not a struct, orders the pieces: the sums then need no sorting. The piece without a lead opens the flow.
        F.min_by("first_forward", F.col("first") * 2 + lead.isNotNull().cast("int")).alias("first_forward"),
        F.min("ip_version").alias("ip_version"),
        F.min(F.least("least_gap", lead)).alias("least_gap"),
        F.max(F.greatest("most_gap", lead)).alias("most_gap"),
        F.sum(F.col("gap_square") + F.coalesce(_square(lead), F.lit(0))).alias("gap_square"),
        *[F.sum(f).alias(f) for f in FLAGS],
    )


def link(slices: DataFrame, idle_ms: int) -> DataFrame:
    """Add to each slice ``before`` (the pair's last time in earlier slices), ``start`` (first time of
    its idle-gap session) and ``lead`` (the gap to ``before`` inside the session)."""
    over = Window.partitionBy(*PAIR).orderBy("slice")
    gap = F.col("first") - F.col("before")
    opens = F.when(F.col("before").isNull() | (gap > idle_ms), F.col("first"))
    return (
        slices.withColumn("before", F.lag("last").over(over))
        .withColumn("start", F.max(opens).over(over.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lead", F.when(F.col("before") >= F.col("start"), gap))
    )


# --------------------------------------------------------------------------- active timeout


SESSION = [*PAIR, "start"]
#: What :func:`combine` puts together per flow.
PIECE = [*SESSION, "first", "last", "n", "bytes", "square", "smallest", "largest", "forward_n", "forward_bytes",
         "first_forward", "ip_version", "least_gap", "most_gap", "gap_square", "lead", *FLAGS]


def _next_start(points: DataFrame, active_ms: int, slice_ms: int) -> DataFrame:
    """For each point of a session the first point more than ``active_ms`` later, or NULL."""
    data = points.select(*SESSION, "t", F.col("t").alias("_at"), F.lit(1).alias("_is_point"))
    asks = points.select(*SESSION, "t", (F.col("t") + active_ms).alias("_at"), F.lit(0).alias("_is_point"))
    both = data.unionByName(asks).withColumn("_slice", _bucket(F.col("_at"), slice_ms))
    # Latest first; a question comes before the point at the same instant, which is not "later".
    later = Window.partitionBy(*SESSION, "_slice").orderBy(F.desc("_at"), "_is_point")
    point = F.when(F.col("_is_point") == 1, F.col("_at"))
    both = both.withColumn(
        "_found", F.last(point, ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0))
    )
    heads = (
        both.groupBy(*SESSION, "_slice").agg(F.min(point).alias("_head"))
        .withColumn(
            "_beyond",
            F.first("_head", ignorenulls=True).over(
                Window.partitionBy(*SESSION).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
            ),
        )
        .drop("_head")
    )
    return (
        both.filter(F.col("_is_point") == 0)
        .join(heads, [*SESSION, "_slice"])
        .select(*SESSION, "t", F.coalesce("_found", "_beyond").alias("next"))
    )


def pass_over(points: DataFrame, active_ms: int) -> DataFrame:
    """Starts of the flows that sessions are cut into, by one pass over the times of each session."""
    times = points.groupBy(*SESSION).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    begin = F.struct(F.col("start").alias("at"), F.array("start").alias("found"))
    starts = F.aggregate(
        "ts", begin,
        lambda seen, t: F.when(t - seen["at"] > active_ms, F.struct(
            t.alias("at"), F.array_append(seen["found"], t).alias("found"))).otherwise(seen),
        lambda seen: seen["found"])
    return times.select(*SESSION, F.explode(starts).alias("t"))


def cut_points(points: DataFrame, idle_ms: int, active_ms: int, longest_ms: int, slice_ms: int) -> DataFrame:
    """Starts of the flows a session is cut into; ``points`` are its packet times.

    Time since the session start is divided into blocks of ``active_ms + 1``: two starts never share one.
    Level k holds, for the points that can be the first start in a block of 2**k blocks, the first start
    after it. Going up doubles the blocks, going down collects the starts. Writes each level to the shared
    folder, as the next level and the way down read it.
    """
    width = active_ms + 1
    reach = active_ms + idle_ms  # the first start in a block comes less than this after its beginning
    offset = F.col("t") - F.col("start")

    def block(column: str, size: int) -> Column:
        return _bucket(F.col(column) - F.col("start"), size)

    levels = [written(_next_start(points, active_ms, slice_ms), "cuts")]
    while width < longest_ms + 1:
        below, width = levels[-1], width * 2
        hop = below.select(*SESSION, F.col("t").alias("next"), F.col("next").alias("_second"))
        level = (
            below.filter(offset % width < reach)
            .join(hop, [*SESSION, "next"], "left")
            .withColumn(
                "next",
                F.when(block("next", width) == block("t", width), F.col("_second")).otherwise(F.col("next")),
            )
            .select(*SESSION, "t", "next")
        )
        levels.append(written(level, "cuts"))

    starts = points.filter("t = start")
    for level in reversed(levels[:-1]):
        inside = F.when(block("next", width) == block("t", width), F.col("next"))
        starts = starts.join(level, [*SESSION, "t"], "left").select(
            *SESSION, F.explode(F.array_compact(F.array("t", inside))).alias("t")
        )
        width //= 2
    return starts


def _long_flows(rows: DataFrame, slices: DataFrame, spans: DataFrame, idle_ms: int, active_ms: int,
                longest_ms: int, slice_ms: int, large: bool) -> DataFrame:
    """Pieces of the sessions longer than ``active_ms``, with the start of their flow as ``start``."""
    long_slices = slices.join(spans.select(*SESSION), SESSION)
    # Slice by slice, so that a hot session meets its packets in many tasks.
    points = written(
        with_previous(rows).join(long_slices.filter("NOT held").select(*PAIR, "slice", "before", "start"), [*PAIR, "slice"])
        .withColumn("prev", F.coalesce("prev", "before")).drop("before"),
        "points",
    )
    times = points.select(*SESSION, "t")
    starts = pass_over(times.join(spans.filter(F.col("n") <= CHASE_ROWS).select(*SESSION), SESSION), active_ms)
    if large:
        times = times.unionByName(long_slices.filter("held").select(*SESSION, F.col("start").alias("t"))).distinct()
        times = times.join(spans.filter(F.col("n") > CHASE_ROWS).select(*SESSION), SESSION)
        starts = starts.unionByName(cut_points(times, idle_ms, active_ms, longest_ms, slice_ms))
        starts = written(starts, "starts")

    width = active_ms + 1
    in_session = Window.partitionBy(*SESSION).orderBy("t")

    def block(column: Column) -> Column:
        return _bucket(column - F.col("start"), width)

    # Each start covers the blocks up to the next one; at most a few blocks per start.
    cover = (
        starts.withColumn("_until", F.lead("t").over(in_session))
        .join(spans, SESSION)
        .withColumn("_until", F.coalesce("_until", F.col("end") + 1))
        .select(
            *SESSION, F.col("t").alias("_from"), "_until",
            F.explode(
                F.sequence(block(F.col("t")), block(F.col("_until") - 1), F.lit(width).cast("bigint"))
            ).alias("_block"),
        )
    )
    cut = (
        points.withColumn("_block", block(F.col("t")))
        .join(cover, [*SESSION, "_block"])
        .filter((F.col("t") >= F.col("_from")) & (F.col("t") < F.col("_until")))
        .withColumn("start", F.col("_from"))
        .withColumn("prev", F.when(F.col("prev") >= F.col("start"), F.col("prev")))
    )
    return pieces(cut).select(*PIECE).unionByName(long_slices.filter("held").select(*PIECE))


# --------------------------------------------------------------------------- flows


def _deviation(square: Column, total: Column, n: Column) -> Column:
    """Sample standard deviation from whole-number sums; 0 for a single value."""
    spread = square * n.cast("decimal(19,0)") - _square(total)
    pairs = n.cast("double") * F.greatest(n - 1, F.lit(1)).cast("double")
    return F.when(n > 1, F.sqrt(spread.cast("double") / pairs)).otherwise(F.lit(0.0))


def flows_from_sums(sums: DataFrame) -> DataFrame:
    """The flow record of each flow that :func:`combine` put together."""

    def by_direction(a_to_b: str, b_to_a: str) -> Column:
        return F.when(F.col("first_forward"), F.col(a_to_b)).otherwise(F.col(b_to_a))

    packets, gaps, duration = F.col("n"), F.col("n") - 1, F.col("last") - F.col("start")
    named = sums.withColumns({
        "_other_n": packets - F.col("forward_n"),
        "_other_bytes": F.col("bytes") - F.col("forward_bytes"),
    }).select(
        F.timestamp_millis("last").alias("collected_at"),
        by_direction("ip_a", "ip_b").alias("src_ip"),
        by_direction("ip_b", "ip_a").alias("dst_ip"),
        by_direction("port_a", "port_b").alias("src_port"),
        by_direction("port_b", "port_a").alias("dst_port"),
        "protocol", "ip_version",
        F.col("start").alias("bidirectional_first_seen_ms"),
        F.col("last").alias("bidirectional_last_seen_ms"),
        (F.col("last") - F.col("start")).alias("bidirectional_duration_ms"),
        packets.alias("bidirectional_packets"),
        F.col("bytes").alias("bidirectional_bytes"),
        by_direction("forward_n", "_other_n").alias("src2dst_packets"),
        by_direction("forward_bytes", "_other_bytes").alias("src2dst_bytes"),
        by_direction("_other_n", "forward_n").alias("dst2src_packets"),
        by_direction("_other_bytes", "forward_bytes").alias("dst2src_bytes"),
        F.col("smallest").alias("bidirectional_min_ps"),
        (F.col("bytes") / packets).alias("bidirectional_mean_ps"),
        _deviation(F.col("square"), F.col("bytes"), packets).alias("bidirectional_stddev_ps"),
        F.col("largest").alias("bidirectional_max_ps"),
        F.coalesce(F.col("least_gap").cast("double"), F.lit(0.0)).alias("bidirectional_min_piat_ms"),
        F.when(gaps > 0, duration / F.greatest(gaps, F.lit(1))).otherwise(F.lit(0.0)).alias("bidirectional_mean_piat_ms"),
        _deviation(F.col("gap_square"), duration, F.greatest(gaps, F.lit(1)))
        .alias("bidirectional_stddev_piat_ms"),
        F.coalesce(F.col("most_gap").cast("double"), F.lit(0.0)).alias("bidirectional_max_piat_ms"),
        *[F.col(f).alias(f"bidirectional_{f}_packets") for f in FLAGS],
    )
    return as_flows(named)


def as_flows(named: DataFrame) -> DataFrame:
    """The 37 flow columns: adds id, rates and the application columns a packet table cannot tell."""
    return named.withColumns({
        "flow_id": flow_id(),
        "packets_per_second": per_second("bidirectional_packets"),
        "bytes_per_second": per_second("bidirectional_bytes"),
        "application_name": F.lit(""),
        "application_category_name": F.lit(""),
        "application_is_guessed": F.lit(0),
        "application_confidence": F.lit(0.0),
        "requested_server_name": F.lit(""),
    }).select(*[F.col(f.name).cast(f.dataType) for f in FLOWS.fields])


def linked_slices(pairs: DataFrame, idle_ms: int, slice_ms: int, held: DataFrame | None = None) -> DataFrame:
    """Slices of the packets with their sums and sessions; ``slice_ms`` is at most ``idle_ms``.

    ``held``: one open flow of a pair at most (the columns of PIECE but ``lead``), none later than the packets. It comes
    before its pair's slices as one that is ``held``.
    """
    rows = with_previous(merge_instants(pairs, slice_ms))
    slices = combine(pieces(rows), [*PAIR, "slice"]).withColumn("held", F.lit(False))
    if held is not None:
        early = held.withColumns({"slice": _bucket(F.col("last"), slice_ms) - 1, "held": F.lit(True)}).drop("start")
        slices = slices.unionByName(early.select(*slices.columns))
    return link(slices, idle_ms)


def flow_sums(pairs: DataFrame, idle_ms: int, active_ms: int | None, slice_ms: int, held: DataFrame | None = None) -> DataFrame:
    """The sums of each flow (:func:`combine` by SESSION) of the packets of :func:`with_pair`, open flows ``held`` continued.

    With an active timeout the slices are written to the shared folder and measured, which runs jobs.
    """
    slice_ms = max(1, min(slice_ms, idle_ms))
    slices = linked_slices(pairs, idle_ms, slice_ms, held)
    if active_ms is None:
        return combine(slices, SESSION)
    slices = written(slices, "slices")
    spans = slices.groupBy(*SESSION).agg(F.max("last").alias("end"), F.sum("n").alias("n"))
    spans = spans.filter(F.col("end") - F.col("start") > active_ms)
    longest, n_long, n_large = spans.agg(
        F.max(F.col("end") - F.col("start")), F.count(F.lit(1)), F.count_if(F.col("n") > CHASE_ROWS)).first()
    if not n_long:
        return combine(slices, SESSION)
    if n_long <= FEW_SESSIONS:
        # Counted, so small enough to send to every task: other pairs' packets are not shuffled again.
        pairs = pairs.join(F.broadcast(spans.select(*PAIR).distinct()), PAIR, "left_semi")
    rows = merge_instants(pairs, slice_ms)
    long_flows = _long_flows(rows, slices, spans, idle_ms, active_ms, longest, slice_ms, n_large > 0)
    short = slices.join(spans.select(*SESSION), SESSION, "left_anti").select(*PIECE)
    return combine(short.unionByName(long_flows), SESSION)


def meter(
    packets: DataFrame,
    idle_s: float = IDLE_S,
    active_s: float | None = ACTIVE_S,
    slice_s: int = SLICE_S,
) -> DataFrame:
    """Packets to flows.

    ``slice_s`` bounds the sorted unit: a task sees at most 1000 * ``slice_s`` merged rows of one pair.
    With an active timeout it runs jobs; ``active_s=None`` cuts at idle gaps only and stays lazy.
    """
    active_ms = None if active_s is None else int(active_s * 1000)
    return flows_from_sums(flow_sums(with_pair(packets), int(idle_s * 1000), active_ms, slice_s * 1000))


def inter_arrival(packets: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Per pair and millisecond the time since the pair's previous packet (NULL for its first)."""
    rows = merge_instants(with_pair(packets), slice_s * 1000).select(*PAIR, "slice", "t", "n")
    ends = rows.groupBy(*PAIR, "slice").agg(F.max("t").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*PAIR).orderBy("slice"))).drop("last")
    linked = with_previous(rows).join(before, [*PAIR, "slice"])
    return linked.select(*PAIR, "t", "n", (F.col("t") - F.coalesce("prev", "before")).alias("gap_ms"))


def sessions(packets: DataFrame, idle_s: float = IDLE_S, slice_s: int = SLICE_S) -> DataFrame:
    """Idle-gap sessions per pair: first and last time, packets, bytes."""
    idle_ms = int(idle_s * 1000)
    slice_ms = max(1, min(slice_s * 1000, idle_ms))
    # Without gap statistics nothing has to be sorted but the slices.
    slices = with_pair(packets).groupBy(*PAIR, _bucket(F.col("t"), slice_ms).alias("slice")).agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    return link(slices, idle_ms).groupBy(*SESSION).agg(
        F.max("last").alias("end"), F.sum("n").alias("packets"), F.sum("bytes").alias("bytes")
    )
