"""Shard documents by balanced label propagation over equal texts.

Documents are linked when their texts are equal, through their group instead of pair by
pair. They start on shards in turn; in every round each group names the shard where most
of it lies, its other members ask to move there, and a quota for each pair of shards
admits as many as keep every shard within its share. Members of a group on one shard are
alike, so a round joins and moves counts (group, shard, n), however large the group.
Groups left in pieces where all shards are full then change places with each other.
Documents without links then fill every shard to its exact share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import hex_digits, id_and_text, keyed, running_total, stored

SHARDS, ROUNDS = 24, 8


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "_row", "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.sha2("text", 256).alias("group"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("_row")))).alias("place"),
    )


def _of(shard: str, values: list[int]) -> Column:
    """The shard's value."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard) + 1)


def _loads(counts: DataFrame, shards: int) -> list[int]:
    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    return [held.get(s, 0) for s in range(shards)]


def admitted(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the moves asked for, by (from, to), may go: no shard gains more than it has free."""
    flow = dict(asked)
    while True:
        over = False
        for s, room in enumerate(free):
            into = {k: n for k, n in flow.items() if k[1] == s and n}
            gain = sum(into.values()) - sum(n for k, n in flow.items() if k[0] == s)
            if (excess := gain - room) > 0:
                over, total = True, sum(into.values())
                cuts = {k: n * excess // total for k, n in into.items()}
                for k in sorted(into, key=lambda k: (cuts[k] - into[k], k))[: excess - sum(cuts.values())]:
                    cuts[k] += 1
                flow |= {k: n - cuts[k] for k, n in into.items()}
        if not over:
            return flow


def _propagate(counts: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """counts (group, shard, n) after the rounds; shards stay within their quotas."""
    full: set[int] = set()
    blocked = 0
    k = hex_digits(counts.count())
    for turn in range(rounds):
        free = [q - n for q, n in zip(quotas, _loads(counts, len(quotas)), strict=True)]
        # A group needs as many shards as its rows over a share: those where most of it lies. Its other rows ask to
        # move there, except to a shard that it fills alone or that had no room in the last round.
        own, open_ = F.col("n") >= _of("shard", quotas), ~F.col("shard").isin(*full) if full else F.lit(True)
        tie = F.xxhash64("group", "shard", F.lit(turn))  # another one each round, so that blocked moves turn about
        rank = F.struct((-F.col("n")).alias("less"), tie.alias("tie"), F.col("shard"), (~own & open_).alias("takes"))
        group = Window.partitionBy("group")  # a row a shard
        aims = counts.withColumn("rank", rank).withColumn("ranks", F.sort_array(F.collect_list("rank").over(group))).withColumn("at", F.array_position("ranks", F.col("rank")))
        needs = F.greatest(F.lit(1), F.ceil(F.sum("n").over(group) / max(min(quotas), 1))).cast("int")
        aims = aims.withColumn("needs", needs).withColumn("aims", F.filter(F.slice("ranks", 1, F.col("needs")), lambda r: r["takes"]))
        aims = aims.where((F.col("at") > F.col("needs")) & (F.size("aims") > 0))
        to = F.get("aims", ((F.col("at") - 1) % F.size("aims")).cast("int"))["shard"]
        moves = stored(aims.select("group", "shard", to.alias("to"), "n"))
        asked = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # at most shards squared
        if not asked or blocked == 2:
            break
        flow = {p: n for p, n in admitted(asked, free).items() if n}
        into = lambda d, s: sum(n for p, n in d.items() if p[1] == s)
        full = {s for s in range(len(quotas)) if 2 * into(flow, s) < into(asked, s)}
        blocked = 0 if flow else blocked + 1
        if not flow:
            continue
        quota = moves.sparkSession.createDataFrame([(*p, n) for p, n in flow.items()], "shard int, to int, quota long")
        moves = running_total(moves.join(F.broadcast(quota), ["shard", "to"]), ["shard", "to"], F.substring("group", 1, k), [F.col("group")], F.col("n"), "before")
        go = moves.withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before")))).where("n > 0")
        change = go.select("group", "shard", (-F.col("n")).alias("n")).union(go.select("group", "to", "n"))
        counts = stored(counts.union(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return counts


def _settle(counts: DataFrame, quotas: list[int]) -> DataFrame:
    """counts after the groups that would fit a shard and still lie on several have changed places.

    Where every shard is full no single move is admitted. So these groups are all taken off
    their shards and laid one after the other along the room that is free then: of them one
    a border between two shards stays cut at most, whatever their number.
    """
    whole = counts.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"))
    loose = stored(whole.where((F.col("shards") > 1) & (F.col("n") <= min(quotas))).select("group", "n"))
    n = loose.count()
    if not n:
        return counts
    kept = stored(counts.join(loose.select("group"), "group", "left_anti"))
    room = [q - held for q, held in zip(quotas, _loads(kept, len(quotas)), strict=True)]
    laid = running_total(loose, [], F.substring("group", 1, hex_digits(n)), [F.col("group")], F.col("n"), "start")
    end, pieces = F.col("start") + F.col("n"), []
    for s, size in enumerate(room):
        low = sum(room[:s])
        part = F.least(end, F.lit(low + size)) - F.greatest(F.col("start"), F.lit(low))
        pieces.append(F.struct(F.lit(s).alias("shard"), part.cast("long").alias("n")))
    placed = laid.select("group", F.explode(F.filter(F.array(*pieces), lambda p: p["n"] > 0)).alias("p")).select("group", "p.shard", "p.n")
    return stored(kept.select("group", "shard", "n").union(placed))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row a document of docs (_row, doc_id, text): _row, doc_id, size, text_crc32, shard, slot.

    Counts of rows of any two shards differ by one at most. Null texts have size 8 and no
    links; empty texts are equal to each other, very long ones are digested whole. A group
    larger than a shard's share covers as few shards as the quotas let it; of the others
    shards - 1 are cut at most. Repeated rows are equal texts, ties are broken by digests.
    Slots run from 0 without gaps on each shard; with fewer rows than shards some shards
    are empty, and all of an empty table. Other columns are not read.
    """
    nodes = stored(_nodes(docs))
    # Stored, so that the join below has plain shuffles on both sides and Spark can split a group that many rows have.
    groups = stored(nodes.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    nodes = stored(nodes.join(groups, "group", "left"))
    total, tied = nodes.agg(F.count(F.lit(1)), F.count("members")).first()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    k, order, one = hex_digits(total), [F.col("place"), F.col("_row")], F.lit(1)
    bucket = F.substring("place", 1, k)

    linked = nodes.where("members is not null")
    started = running_total(linked, [], bucket, order, one, "turn").select("group", (F.col("turn") % shards).cast("int").alias("shard"))
    counts = stored(started.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")))
    if tied:
        counts = _settle(_propagate(counts, quotas, rounds), quotas)
    loads = _loads(counts, shards)

    by_group = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = running_total(counts, ["shard"], F.substring("group", 1, k), [F.col("group")], F.col("n"), "start")
    low = F.coalesce(F.sum("n").over(by_group), F.lit(0))
    places = places.withColumn("range", F.struct(low.alias("low"), "n", "start", "shard"))
    ranges = places.groupBy("group").agg(F.collect_list("range").alias("ranges"))  # at most one a shard
    tied_rows = running_total(linked, ["group"], bucket, order, one, "nth", beside=ranges)
    mine = F.filter("ranges", lambda r: (F.col("nth") >= r["low"]) & (F.col("nth") < r["low"] + r["n"]))[0]
    tied_rows = tied_rows.withColumn("range", mine).withColumn("shard", F.col("range.shard")).withColumn("slot", F.col("range.start") + F.col("nth") - F.col("range.low"))

    room = [q - n for q, n in zip(quotas, loads, strict=True)]
    lows = [sum(room[:s]) for s in range(shards)]
    single = running_total(nodes.where("members is null"), [], bucket, order, one, "nth")
    shard = sum((F.col("nth") >= low).cast("int") for low in lows) - 1
    single = single.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("nth") - _of("shard", lows) + _of("shard", loads))
    columns = ["_row", "doc_id", "size", "text_crc32", "shard", "slot"]
    return tied_rows.select(*columns).union(single.select(*columns))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs plus shard and slot (columns of docs with these names are replaced)."""
    rows = keyed(docs.drop("shard", "slot"))
    return rows.join(stored(assign(id_and_text(rows), shards).select("_row", "shard", "slot")), "_row").select("_doc.*", "shard", "slot")


def op4(docs: DataFrame) -> DataFrame:
    rows = assign(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
