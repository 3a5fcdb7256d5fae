"""Exact Jaccard join on word n-grams with a vertically partitioned count, and its connected components.

A document's set holds the hashes of its distinct word n-grams; documents with equal sets form a class, and
classes are what is joined (as nodes, numbered by 64 bits of a 128-bit hash of the set; sets whose numbers agree but
whose other 64 bits do not are numbered anew). Two sets that are similar enough share one of
the first p = n - ceil(t n) + 1 members of each, under any common order. The order used here has the n-grams that
many sets share last, the most frequent at the very end, so lists of sets with a common member stay short.

The order is cut into fragments, by hash range and with the frequent part as one more. The overlap of a pair is counted in
each fragment on its own and summed per pair.

Large groups of near copies would still give all pairs of their members. They are joined around centres instead:

1. every set is paired with one leader, the set of fewest unshared members among those it meets; what proves
   similar is joined into components, and leaders with all they lead, directly or not, are a family; so are sets
   that more than ``BLOCK`` others share a first member with;
2. where a family falls into several components, its sets are compared in blocks, which return
   no pairs of sets but, of the components they find linked, a spanning forest;
3. each component has a centre and a radius, the largest distance (1 - Jaccard) of a member;
4. components whose sets share a first member across families are candidates, unless sizes or the number of
   shared ones rule out any link; Jaccard distance is a metric, so two of them can only be linked if
   their centres are at most 1 - t plus both radii apart;
5. what remains is compared in blocks again.

So no link between different components can be missed, and pairs inside one are not enumerated.

N-grams are told apart by 64-bit hashes. Two different ones that share a hash count as one: among the m n-grams that one pair of
documents has, that takes place with a chance of about m^2 / 2^65, and it moves an overlap by one.

Defined cases: null or blank text has an empty set, which is linked with nothing. Fewer words than n: the whole sequence is the
one member. Repeated rows are one class; so are texts that differ but have equal sets. component_id is
the smallest id of the component, ignoring null ids; null if all are. An empty table gives an empty result. Other columns pass
through; those called n_shingles or component_id are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runlens.llm.common import giving_back, row_key, table, text_bytes
from runlens.llm.components import components
from runlens.session import broadcast_if_small

#: At least this many sets share a member that the order puts last; how many such members the order tells apart.
FREQUENT = 16
ORDER_SIZE = 1_000_000
FRAGMENTS = 4
BLOCK = 256
#: A set joins its leader's family if one in so many of its members is known to be common.
FAMILY_SHARE = 50
CACHED_WORDS = 250_000
_SLACK = 1e-9
_WORDS: dict[bytes, int] = {}
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % j) | 1) for j in range(64)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = _WORDS
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        pass
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.int64)
    h = _word_hashes(found)
    if len(h) < words:
        n = np.uint64(len(h))
        return _mixed(np.array([sum(int(v) * int(m) for v, m in zip(h, _ODD, strict=False)) % 2**64], np.uint64) + n).view(np.int64)
    grams = np.zeros(len(h) - words + 1, np.uint64)
    for j in range(words):
        grams += h[j : len(h) - words + 1 + j] * _ODD[j]
    return np.unique(_mixed(grams).view(np.int64))


def node_of(members: np.ndarray) -> tuple[int, int]:
    """A class's number and what tells it from other classes of that number: a 128-bit hash of its set."""
    high, low = divmod(xxhash.xxh3_128_intdigest(members.tobytes()), 2**64)
    return low - 2**63, high - 2**63


def prefix_length(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _scan(docs: DataFrame, words: int, row, fields: str) -> DataFrame:
    """Key, node, twin, n and what ``row`` makes of a set, a tuple of arrays, for every document that has one."""
    names = ["key", "node", "twin", "n", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                place, numbers, n, made = [], [], [], []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    members = shingles(body, words)
                    if len(members):
                        place.append(i)
                        numbers.append(node_of(members))
                        n.append(len(members))
                        made.append(row(members))
                columns = [_lists(list(c)) for c in zip(*made, strict=True)] if made else [_lists([])] * (len(names) - 4)
                node, twin = (pa.array([x[i] for x in numbers], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(place, pa.int64())), node, twin, pa.array(n, pa.int64()), *columns],
                    names=names,
                )

    schema = f"key struct<a:bigint,b:bigint>, node bigint, twin bigint, n bigint, {fields}"
    return docs.mapInArrow(giving_back(run), schema)


class _Order:
    """The frequent members, sorted, with their ranks in the order."""

    def __init__(self, counted: DataFrame):
        top = counted.where(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "token").limit(ORDER_SIZE).toArrow()
        tokens, counts = top.column("token").to_numpy(), top.column("count").to_numpy()
        by_token = np.argsort(tokens)
        self.tokens = tokens[by_token]
        ranks = np.empty(len(tokens), np.int64)
        ranks[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.ranks = ranks[by_token]

    def split(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of a set in order: the light ones, then the frequent ones."""
        if not len(self.tokens):
            return members, members[:0]
        at = np.minimum(np.searchsorted(self.tokens, members), len(self.tokens) - 1)
        frequent = self.tokens[at] == members
        tail = members[frequent]
        return members[~frequent], tail[np.argsort(self.ranks[at[frequent]])]


class NgramJoin:
    """The steps of the join over one table of documents; ``key`` stands for a row, ``node`` for a class."""

    def __init__(self, docs: DataFrame, text: str, id_column: str, words: int, threshold: tuple[int, int]):
        self.spark, self.words, self.threshold = docs.sparkSession, words, threshold
        self.t = threshold[0] / threshold[1]
        self.bodies = docs.select(row_key(id_column, text).alias("key"), text_bytes(text).alias("body"))
        self.sets: list[DataFrame] = []
        self.twins: DataFrame | None = None

    def _scan(self, docs: DataFrame, row, fields: str) -> DataFrame:
        """As the function of this name, with a number of its own for every class."""
        found = _scan(docs, self.words, row, fields)
        if self.twins is not None:
            found = found.join(self.twins, ["node", "twin"], "left").withColumn("node", F.coalesce("own", "node")).drop("own")
        return found.drop("twin")

    def _find_twins(self, rows: DataFrame) -> None:
        """Classes that share their number, with one of their own. N classes have some N^2 / 2^65 pairs of these. Runs a job."""
        told = rows.groupBy("node").agg((F.min("twin") < F.max("twin")).alias("several")).where("several")
        told = table(told.select("node"), "twins")
        if not told.isEmpty():
            classes = rows.join(broadcast_if_small(told), "node").select("node", "twin").distinct()
            self.twins = broadcast_if_small(table(classes.withColumn("own", F.xxhash64("node", "twin")), "twins"))

    # -- sets and their first members --------------------------------------------------------

    def read(self) -> DataFrame:
        """key, node and n of every document with a set; fixes the order and keeps first members."""
        t = self.threshold
        read = table(_scan(self.bodies, self.words, lambda s: (s[: prefix_length(len(s), t)],), "first array<bigint>"), "sets")
        self._find_twins(read)
        if self.twins is not None:
            read = table(read.join(self.twins, ["node", "twin"], "left").withColumn("node", F.coalesce("own", "node")), "sets")
        self.rows = read.select("key", "node", "n", "first")
        one = self.rows.groupBy("node").agg(F.first("first").alias("first"))
        counted = one.select(F.explode("first").alias("token")).groupBy("token").count()
        order = _Order(counted)
        self.order = self.spark.sparkContext.broadcast(order)
        shared = self.order

        def ordered(members):
            p = prefix_length(len(members), t)
            light, frequent = shared.value.split(members)
            return light[:p], frequent[: max(0, p - len(light))]

        second = self._scan(self.bodies, ordered, "light array<bigint>, frequent array<bigint>")
        firsts = second.groupBy("node").agg(F.first(F.struct("n", "light", "frequent")).alias("v"))
        self.firsts = table(firsts.select("node", "v.*"), "firsts")
        return self.rows.select("key", "node", "n")

    def shared_members(self) -> DataFrame:
        """token, node, pos (place in the set's order) for members among the first ones that two sets or more have there.

        Frequent members are known to be shared. Light ones are in few sets, so a token's rows fit anywhere.
        """
        light = self.firsts.select("node", F.posexplode("light").alias("pos", "token")).select("token", "node", "pos")
        light = light.repartition("token").sortWithinPartitions("token")

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.empty(0, np.int64)] * 3
            for batch in batches:
                now = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
                whole = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last token may go on
                yield _shared(*[x[:whole] for x in now])
                held = [x[whole:] for x in now]
            yield _shared(*held)

        found = light.mapInArrow(giving_back(runs), "token bigint, node bigint, pos int")
        frequent = self.firsts.where(F.size("frequent") > 0)
        frequent = frequent.select("node", F.size("light").alias("n_light"), F.posexplode("frequent").alias("pos", "token"))
        return table(found.unionByName(frequent.select("token", "node", (F.col("pos") + F.col("n_light")).alias("pos"))), "shared")

    # -- exact overlaps ----------------------------------------------------------------------

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """node, fragment, members for (at least) these nodes; sets that an earlier call read are reused."""
        missing = nodes.distinct()
        for had in self.sets:
            missing = missing.join(had.select("node").distinct(), "node", "left_anti")
        missing = table(missing, "nodes")
        order = self.order

        def fragments(members):
            light, frequent = order.value.split(members)
            cut = np.searchsorted(light, [-(2**63) + (2**64 // FRAGMENTS) * i for i in range(1, FRAGMENTS)])
            return (*np.split(light, cut), np.sort(frequent))

        wanted = self.rows.join(missing, "node").groupBy("node").agg(F.min("key").alias("key")).select("key")
        bodies = self.bodies.join(broadcast_if_small(table(wanted, "wanted")), "key")
        # rows that agree in id and text have one key
        columns = [f"f{i}" for i in range(FRAGMENTS + 1)]
        read = self._scan(bodies, fragments, ", ".join(f"{c} array<bigint>" for c in columns))
        parts = F.array(*[F.struct(F.lit(i).alias("fragment"), F.col(c).alias("members")) for i, c in enumerate(columns)])
        each = read.select("node", F.explode(parts).alias("p")).where(F.size("p.members") > 0)
        self.sets.append(table(each.select("node", "p.*").dropDuplicates(["node", "fragment"]), "fragments"))
        out = self.sets[0]
        for more in self.sets[1:]:
            out = out.unionByName(more)
        return out

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``x``, ``y`` and their sizes ``nx``, ``ny``: adds overlap, distance and linked. Runs jobs."""
        pairs = table(pairs.select("x", "y", "nx", "ny").distinct(), "pairs")
        if pairs.isEmpty():
            return pairs.withColumns({"overlap": F.lit(0).cast("long"), "distance": F.lit(1.0), "linked": F.lit(False)})
        sets = self._sets_of(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))))
        left = sets.select(F.col("node").alias("x"), "fragment", F.col("members").alias("mx"))
        right = sets.select(F.col("node").alias("y"), "fragment", F.col("members").alias("my"))
        met = pairs.select("x", "y").join(left, "x").join(right, ["y", "fragment"])
        partial = met.select("x", "y", F.size(F.array_intersect("mx", "my")).cast("long").alias("partial"))
        overlaps = partial.groupBy("x", "y").agg(F.sum("partial").alias("overlap"))
        known = pairs.join(overlaps, ["x", "y"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
        union = F.col("nx") + F.col("ny") - F.col("overlap")
        done = known.withColumns(
            {"distance": 1 - F.col("overlap") / union, "linked": self.threshold[1] * F.col("overlap") >= self.threshold[0] * union}
        )
        return table(done, "verified")

    def possible(self, c: str, x_low: str, x_high: str, y_low: str, y_high: str):
        """Whether sets of these sizes with ``c`` common first members, at most, can be linked.

        Let x be the one whose first members end earlier in the order: all that y has up to there is among y's first members,
        so the overlap is below c + t nx, and it must reach t / (1 + t) (nx + ny).
        """
        t, share = self.t, self.t / (1 + self.t)

        def needed(first_high: str, other_low: str):
            return share * F.col(other_low) - (t - share) * F.col(first_high)

        enough = F.col(c) + _SLACK > F.least(needed(x_high, y_low), needed(y_high, x_low))
        return enough & self._fit(x_low, x_high, y_low, y_high)

    def _reachable(self):
        """Whether components ``a`` and ``b`` can be linked, by the place of their last common first member.

        What two sets share beyond it stands after it in both. A place found over several sets bounds none of them: the set
        that links may have its last one earlier, and share what stands between beyond its own first members.
        """
        after = F.least(F.col("a_high") - F.col("a_pos"), F.col("b_high") - F.col("b_pos")) - 1
        rest = F.when(F.col("a_size") + F.col("b_size") == 2, after).otherwise(F.least("a_high", "b_high"))
        return F.col("c") + rest + _SLACK >= self.t / (1 + self.t) * (F.col("a_low") + F.col("b_low"))

    def _fit(self, x_low: str, x_high: str, y_low: str, y_high: str):
        """Whether the sizes alone allow a link."""
        return (F.col(x_high) + _SLACK >= self.t * F.col(y_low)) & (F.col(y_high) + _SLACK >= self.t * F.col(x_low))

    # -- components --------------------------------------------------------------------------

    def labels(self) -> DataFrame:
        """node, label for every node that is linked with another one. Runs jobs."""
        shared = self.shared_members()
        if shared.isEmpty():
            return shared.select("node", F.col("node").alias("label"))
        sizes = self.firsts.select("node", "n", (F.size("light") + F.size("frequent")).alias("p"))
        met = shared.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        info = table(met.join(sizes, "node").select("node", "n", F.floor(1000 * (F.col("p") - F.col("met")) / F.col("p")).alias("alone")), "info")

        # 1. leaders
        ranked = shared.join(info, "node")
        leaders = table(ranked.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("leader")), "leaders")
        paired = ranked.join(leaders, "token").where(F.col("node") != F.col("leader.node"))
        paired = paired.groupBy(
            F.col("node").alias("x"), F.col("n").alias("nx"), F.col("leader.node").alias("y"), F.col("leader.n").alias("ny")
        ).agg(F.count(F.lit(1)).alias("c"))
        best = paired.groupBy("x", "nx").agg(F.max(F.struct("c", "y", "ny")).alias("b")).select("x", "nx", "b.*")
        # c leaves out what x shares with y under other leaders, so little of it still makes a family
        best = table(best.where(FAMILY_SHARE * F.col("c") >= F.col("nx")), "best")
        stars = self.verify(best.where(self.possible("c", "nx", "nx", "ny", "ny")))
        found = components(stars.where("linked"))
        members = info.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))

        # 2. families
        counted = shared.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
        crowds = table(shared.join(counted.where(F.col("k") > BLOCK).select("token"), "token").select("token", "node"), "crowds")
        # a set is tied to one of its crowds, and that one to the set's others: few pairs, as sets have them in common
        own = table(crowds.groupBy("node").agg(F.min("token").alias("x")), "own-crowds")
        others = crowds.join(own, "node").where("token <> x").select("x", F.col("token").alias("y")).distinct()
        ties = best.select("x", "y").unionByName(own.select("x", F.col("node").alias("y"))).unionByName(others)
        led = components(ties).withColumnRenamed("label", "family")
        placed = members.join(led, "node", "left").withColumn("family", F.coalesce("family", "node"))
        members = table(placed, "members")
        inner = self._families(members)

        # 3. centres and radii
        centres = members.groupBy("label").agg(
            F.min(F.struct("alone", "node", "n")).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("size")
        )
        centres = table(centres, "centres")
        spokes = members.join(centres.where("size > 1"), "label").where(F.col("node") != F.col("c.node"))
        spokes = table(spokes.select("label", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c.node").alias("y"), F.col("c.n").alias("ny")), "spokes")
        had = stars.select("x", "y", "distance")
        turned = stars.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")
        had = had.unionByName(turned)
        new = self.verify(spokes.join(had, ["x", "y"], "left_anti"))
        away = spokes.join(had.unionByName(new.select("x", "y", "distance")), ["x", "y"]).groupBy("label", "x").agg(F.max("distance").alias("distance"))
        away = table(away, "away")
        radii = away.groupBy("label").agg(F.max("distance").alias("radius"))
        known = centres.join(radii, "label", "left").select(
            "label", F.col("c.node").alias("centre"), F.col("c.n").alias("n"), "low", "high", "size", F.coalesce("radius", F.lit(0.0)).alias("radius")
        )
        known = table(known, "components")

        # 4. candidates
        # a component of one set also tells where in its order the shared members stand; others leave that open
        places = members.select("node", "label", "family").join(known.select("label", "size", "low", "high"), "label")
        place = F.when(F.col("size") == 1, F.col("pos")).otherwise(-1).alias("pos")
        where = shared.join(places, "node").select("token", "label", "family", place, "low", "high")
        where = table(where.distinct(), "placed")
        several = where.groupBy("token").agg((F.min("family") < F.max("family")).alias("k")).where("k").select("token")
        here = table(where.join(several, "token"), "several")
        a, b = (here.select("token", *[F.col(c).alias(n) for c, n in (("label", side), *((c, f"{side}_{c}") for c in ("family", "pos", "low", "high")))]) for side in "ab")
        apart = F.expr("a < b and a_family <> b_family")
        met = a.join(b, "token").where(apart & self._fit("a_low", "a_high", "b_low", "b_high")).groupBy("a", "b", "token").agg(F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"))
        pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"))
        for side in "ab":
            pairs = pairs.join(known.select(*[F.col(c).alias(side if c == "label" else f"{side}_{c}") for c in known.columns]), side)
        near = table(pairs.where(self.possible("c", "a_low", "a_high", "b_low", "b_high") & self._reachable()), "candidates")
        checked = self.verify(near.select(F.col("a_centre").alias("x"), F.col("a_n").alias("nx"), F.col("b_centre").alias("y"), F.col("b_n").alias("ny")))
        judged = table(
            near.join(checked.select(F.col("x").alias("a_centre"), F.col("y").alias("b_centre"), "distance", "linked"), ["a_centre", "b_centre"]),
            "judged",
        )
        reach = 1 - self.t + F.col("a_radius") + F.col("b_radius") + _SLACK
        open_ = judged.where(~F.col("linked") & (F.col("a_size") + F.col("b_size") > 2) & (F.col("distance") <= reach))

        # 5. set by set
        bridges = judged.where("linked").select(F.col("a").alias("x"), F.col("b").alias("y"))
        bridges = bridges.unionByName(inner).unionByName(self._compare(open_, members, known))
        merged = components(bridges).select(F.col("node").alias("label"), F.col("label").alias("merged"))
        whole = members.select("node", "label").join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label"))
        return table(whole.select("node", "label"), "node-labels")

    def _families(self, members: DataFrame) -> DataFrame:
        """Component pairs, ``x`` and ``y``, linked by sets of one family. Runs jobs."""
        split = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), (F.min("label") < F.max("label")).alias("several"))
        split = table(split.where("several").select("family", F.ceil(F.col("size") / BLOCK).alias("blocks")), "families")
        if split.isEmpty():
            return split.select(F.col("family").alias("x"), F.col("family").alias("y"))
        rows = members.join(split, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        # a set meets its own block and, once, every other one: as the left side of later, the right side of earlier blocks
        left = F.transform(F.sequence("own", F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
        placed = rows.select(F.col("family").alias("g"), "node", "label", "n", F.inline(F.concat(left, right)))
        return self._in_blocks(placed)

    def _compare(self, open_: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
        """Component pairs, ``x`` and ``y``, of ``open_`` that some pair of their sets links. Runs jobs.

        The sets of the larger component meet all sets of the components it is open to.
        """
        turn = F.col("a_size") < F.col("b_size")
        sides = open_.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("g"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("label"))
        sides = table(sides, "open")
        if sides.isEmpty():
            return sides.select(F.col("g").alias("x"), F.col("label").alias("y"))
        others = members.join(sides, "label").select("g", "label", "node", "n")
        counted = others.groupBy("g").agg(F.count(F.lit(1)).alias("ys")).join(known.select(F.col("label").alias("g"), F.col("size").alias("xs")), "g")
        grid = table(counted.select("g", *[F.ceil(F.col(c) / BLOCK).alias(c) for c in ("xs", "ys")]), "grid")

        def at(count: str):
            return F.pmod(F.xxhash64("node"), F.col(count))

        def every(count: str):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

        own = members.select("label", F.col("label").alias("g"), "node", "n").join(grid, "g")
        own = own.select("g", "node", "label", "n", at("xs").alias("i"), every("ys").alias("j"), F.lit(0).alias("side"))
        others = others.join(grid, "g").select("g", "node", "label", "n", every("xs").alias("i"), at("ys").alias("j"), F.lit(1).alias("side"))
        return self._in_blocks(own.unionByName(others))

    def _in_blocks(self, placed: DataFrame) -> DataFrame:
        """``g``, ``i``, ``j`` (a block of the grid), ``side``, node, label, n to pairs of linked labels. Runs jobs.

        A task holds ``BLOCK`` sets of either side, more or less, and returns a spanning forest of the labels that it finds linked.
        """
        placed = table(placed, "placed-sets")
        sets = self._sets_of(placed.select("node"))
        whole = sets.groupBy("node").agg(F.collect_list(F.struct("fragment", "members")).alias("parts"))
        rows = placed.join(whole, "node").select("g", "i", "j", "side", "node", "label", "n", "parts")
        t = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, sides = None, ([], [])
            for batch in batches:
                for at, (*key, side, node, label, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)):
                    if key != block:
                        yield _linked_labels(*sides, t)
                        block, sides = key, ([], [])
                    parts = {p["fragment"].as_py(): p["members"].values.to_numpy() for p in batch.column(7)[at]}
                    sides[side].append((label, n, parts))
            yield _linked_labels(*sides, t)

        in_order = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        return table(in_order.mapInArrow(giving_back(run), "x bigint, y bigint").distinct(), "bridges")


def _linked_labels(xs: list, ys: list, t: tuple[int, int]) -> pa.RecordBatch:
    """Pairs that connect the labels which some set of ``xs`` and some set of ``ys`` link: one less than labels, at most.

    Overlaps are counted by fragment and summed.
    """
    found = []
    if xs and ys:
        overlap = np.zeros((len(ys), len(xs)))
        for fragment in {f for *_, parts in ys for f in parts}:
            y_parts = [parts.get(fragment, _NOTHING) for *_, parts in ys]
            x_parts = [parts.get(fragment, _NOTHING) for *_, parts in xs]
            tokens = np.unique(np.concatenate(y_parts))
            y_rows = _incidence(y_parts, tokens)
            for at in range(0, len(x_parts), 128):
                overlap[:, at : at + 128] += y_rows @ _incidence(x_parts[at : at + 128], tokens).T
        (x_label, x_n), (y_label, y_n) = (np.array([s[:2] for s in side], np.int64).T for side in (xs, ys))
        linked = t[1] * overlap >= t[0] * (y_n[:, None] + x_n[None, :] - overlap)
        linked &= y_label[:, None] != x_label[None, :]
        root: dict[int, int] = {}

        def top(label: int) -> int:
            while root.setdefault(label, label) != label:
                label = root[label]
            return label

        for y, x in np.argwhere(linked):
            a, b = top(int(x_label[x])), top(int(y_label[y]))
            if a != b:
                root[a] = b
                found.append((int(x_label[x]), int(y_label[y])))
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["x", "y"])


def _incidence(parts: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """One row per set, one column per token, 1 where the set has it."""
    out = np.zeros((len(parts), len(tokens)), np.float32)
    flat = np.concatenate(parts)
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    there = tokens[at] == flat
    out[row[there], at[there]] = 1
    return out


_NOTHING = np.empty(0, np.int64)


def _shared(tokens: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    same = tokens[1:] == tokens[:-1] if len(tokens) else np.empty(0, bool)
    keep = np.zeros(len(tokens), bool)
    keep[1:] |= same
    keep[:-1] |= same
    columns = [pa.array(tokens[keep], pa.int64()), pa.array(nodes[keep], pa.int64()), pa.array(places[keep].astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["token", "node", "pos"])


def jaccard_components(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 5, threshold: tuple[int, int] = (80, 100), first: str | None = None
) -> DataFrame:
    """All columns of ``docs``, n_shingles (size of the set) and component_id. Runs jobs.

    ``first`` names a further column: whether the row is the component's document of smallest id, nulls last, and smallest
    row key. Rows equal in id and text are one document. Rows without words are the first of their own.
    """
    join = NgramJoin(docs, text, id_column, words, threshold)
    rows = join.read()
    labels = join.labels()
    named = rows.join(labels, "node", "left").select("key", "n", F.coalesce("label", "node").alias("label"))
    named = table(named.distinct(), "named")
    ids = docs.select(row_key(id_column, text).alias("key"), F.col(id_column).alias("id")).distinct()
    least = named.join(ids, "key").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("key").alias("of"))).alias("least"))
    found = named.join(least, "label").select("key", "n", F.col("least.id").alias("component"), (F.col("key") == F.col("least.of")).alias("first"))
    found = table(found, "found")
    columns = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], row_key(id_column, text).alias("key"))
    joined = keyed.join(found.hint("shuffle_hash"), "key", "left")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        F.coalesce("component", F.col(f"c{columns.index(id_column)}")).alias("component_id"),
        *([F.coalesce("first", F.lit(True)).alias(first)] if first else []),
    )
