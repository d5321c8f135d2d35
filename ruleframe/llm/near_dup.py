"""MinHash near-dedup: signature-coordinate inverted join with exact links.

Plan
----
1. A text's set holds its distinct word shingles (64-bit hashes).  Rows with
   equal sets form one class; only the representative (least id) goes on, so
   copies are never expanded into pairs.
2. Each representative gets ``COORDINATES`` MinHash values.  The number of
   representatives that hold a (coordinate, value) pair is the length of that
   posting list.
3. *Prefix*: a pair must collide in ``matches`` coordinates, so it shares one
   of the ``COORDINATES - matches + 1`` rarest of either side; only those are
   posted, and the longest lists of a text are skipped.  Short lists give all
   their pairs, long lists (over ``short_list`` rows) each member with the
   list's pivot, the member whose lists are longest.  The collisions of these
   pairs are counted on the whole signatures; those with ``matches`` are
   confirmed on the full sets.
4. A long list whose members the links leave in several components is *open*.
   Its members are posted again under the rarest shingles of their full sets
   (two sets that are linked must share one of them), first against a pivot of
   the shingle's list, then rows of different components against each other.
   A passage that a third of the corpus shares is not rare in any of them, and
   a large group of near copies gives as many pairs as rows, not their square.
5. Links become components by alternating large-star and small-star steps over
   stored tables.

What a join on a key that may be hot reads is stored first, so that the
adaptive skew join can split the key's rows.

The collisions asked for follow from the similarity: of 32 coordinates 16 at
0.85 and 14 at 0.80.  A pair at just that similarity collides in fewer, and is
missed, with a probability of 5.7e-7 at 0.85 and 1.2e-6 at 0.80.  Step 4 loses
no pair of an open list.

Defined results: a null or blank text has the empty set, is linked with
nothing and is its own component.  Fewer words than a shingle give one shingle
of all words.  Rows with a null id are left out of the links and keep
themselves.  Equal ids are one document for the components.  Ids may be of any
type that has an order.  Only id and text are read, so other columns, whatever
their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ruleframe.llm.common import discard, likely, mapped, mix64, signed, stored

SHINGLE = 5
COORDINATES = 32
MISS = 2e-6
SHORT_LIST = 16
SET_ROWS = 500
FEWEST_FILES, FILE_ROWS = 8, 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mix64(out + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return base[:n] | np.uint64(1), base[n:]


def signature(hashes: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """MinHash values: the least of each of ``n`` mixings of the set."""
    a, b = _permutations(n)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 2048):
        part = hashes[start : start + 2048]
        x = part[None, :] * a[:, None] + b[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _sketch(n: int, size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, high, low, signatures = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                high.append((both >> 64) - (1 << 63))
                low.append((both & ((1 << 64) - 1)) - (1 << 63))
                signatures.append(signed(signature(s, n)) if len(s) else np.empty(0, dtype=np.int64))
            columns = [*(pa.array(x, pa.int64()) for x in (sizes, high, low)), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "h1", "h2", "sig"])

    return run


def _sets(size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for s in range(0, batch.num_rows, SET_ROWS):
                part = batch.slice(s, SET_ROWS)
                sets = [signed(shingle_set(t.as_py(), size)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the stored ``pairs (a, b)``, by the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), both.alias("both"))
    return joined.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def fits(percent: int, a: str = "na", b: str = "nb"):
    """Sizes alone rule out pairs whose ratio is under the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _collision_posts(classes: DataFrame, matches: int) -> DataFrame:
    """``id, n, mass, coordinate, value, k``: each signature's prefix, rarest lists first.

    ``k`` is the length of the list, ``mass`` the mean over the whole signature.
    Lists of one row have the first places; signatures with fewer than
    ``matches`` lists of more can have no partner.
    """
    each = classes.select("id", "n", F.posexplode("sig").alias("coordinate", "value"))
    lengths = stored(each.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "list-lengths")
    lists = each.join(lengths, ["coordinate", "value"]).groupBy("id", "n").agg(F.collect_list(F.struct("k", "coordinate", "value")).alias("c")).where(F.size("c") >= matches)
    mass = F.expr("aggregate(c, 0D, (s, x) -> s + x.k)")
    posts = lists.select("id", "n", mass.alias("mass"), F.explode(F.expr(f"slice(array_sort(c), 1, size(c) - {matches} + 1)")).alias("p"))
    return posts.select("id", "n", "mass", "p.coordinate", "p.value", "p.k")


def _pair(a: str, b: str, na: str, nb: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(na).alias("na"), F.col(nb).alias("nb")]


def _short_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of the short lists, whose length has a bound."""
    lists = posts.groupBy("coordinate", "value").agg(F.collect_list(F.struct("id", "n")).alias("m")).where(F.size("m") > 1)
    first = lists.select(F.posexplode("m").alias("i", "p"), "m").select("p", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("q"))
    return first.select(*_pair("p.id", "q.id", "p.n", "q.n")).where(fits(percent)).select("a", "b")


def _star_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Every row of a long list with the list's pivot."""
    pivots = stored(posts.groupBy("coordinate", "value").agg(F.max(F.struct("mass", "id", "n")).alias("p")), "pivots")
    pairs = posts.join(pivots, ["coordinate", "value"]).where(F.col("p.id") != F.col("id"))
    return pairs.select(*_pair("id", "p.id", "n", "p.n")).where(fits(percent)).select("a", "b")


def collided(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The stored ``pairs`` whose signatures agree in ``matches`` coordinates."""
    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    hits = F.expr("size(filter(zip_with(x, y, (p, q) -> p = q), e -> e))")
    return pairs.join(right, "b").join(left, "a").where(hits >= matches).select("a", "b")


def _prefix_posts(sets: DataFrame, percent: int) -> DataFrame:
    """Post each set under its rarest shingles: ``id, n, mean, at, shingle``.

    ``at`` is the place of the shingle in the set, rarest first.

    A set of n shingles that is linked shares at least ceil(n * t) of them, so
    one of its n - ceil(n * t) + 1 rarest is among the rarest of the other.
    """
    each = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "shared-shingles")
    # Only shingles of at least two sets can link; the others still take their places in the prefix.
    own = Window.partitionBy("id")
    known = each.join(common, "shingle").withColumns(
        {"i": F.row_number().over(own.orderBy("df", "shingle")), "shared": F.count(F.lit(1)).over(own), "mean": F.sum(F.col("df").cast("double")).over(own) / F.col("n")}
    )
    at = F.col("n") - F.col("shared") + F.col("i") - 1
    room = F.expr(f"n - cast(ceil(n * {percent} / 100.0D - 1e-9) as bigint) + 1")
    return known.withColumn("at", at).where(F.col("at") < room).select("id", "n", "mean", "at", "shingle")


def _reachable(percent: int, a: str = "na", b: str = "nb", at_a: str = "pa", at_b: str = "pb"):
    """What follows the first shared shingle must suffice for the similarity.

    A pair is judged at each shingle it shares; the first one decides rightly,
    and any later one only repeats or misses it.
    """
    needed = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - F.lit(1e-9))
    return F.least(F.col(a) - F.col(at_a), F.col(b) - F.col(at_b)) >= needed


def _open_lists(posts: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Rows of the lists that hold several components, with theirs (``c``) and the largest (``top``)."""
    posts = posts.where(F.col("n") - F.col("at") >= F.ceil(F.col("n") * percent / 100 - F.lit(1e-9)))
    labelled = stored(posts.join(components, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "labelled-posts")
    sizes = labelled.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("shingle").agg(F.max(F.struct("k", "c")).alias("t"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    return stored(labelled.join(stored(top.select("shingle", F.col("t.c").alias("top")), "open-lists"), "shingle"), "open-posts")


def _pivot_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Every row of an open list with the list's pivot."""
    central = F.struct((-F.col("at") / F.col("n")).alias("central"), "mean", "id", "n", "at", "c")
    pivots = stored(posts.groupBy("shingle").agg(F.max(central).alias("p")), "pivots")
    pairs = posts.join(pivots, "shingle").where(F.col("p.c") != F.col("c"))
    pairs = pairs.select(*_pair("id", "p.id", "n", "p.n"), F.col("at").alias("pa"), F.col("p.at").alias("pb"))
    return pairs.where(fits(percent) & _reachable(percent)).select("a", "b").distinct()


def _apart_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of an open list that lie in different components.

    One side holds the rows outside of the list's largest component.
    """
    minor = posts.where(F.col("c") != F.col("top")).select("shingle", F.col("id").alias("i"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("c").alias("ci"))
    other = posts.select("shingle", F.col("id").alias("j"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("c").alias("cj"))
    pairs = minor.join(other, "shingle").where((F.col("ci") != F.col("cj")) & fits(percent) & _reachable(percent))
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every row that has a link; the least id leads.

    Large-star and small-star steps; each round is stored, and the number of
    rounds grows with the logarithm of the longest chain.
    """

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    def kept(df: DataFrame, name: str, rows: int) -> DataFrame:
        """Stored in as many files as so many rows need: rounds on small tables stay cheap."""
        return stored(df.coalesce(max(FEWEST_FILES, rows // FILE_ROWS)), name)

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = kept(edges, "edges", links.count())
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours", before[0])
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        used = (edges, least)
        edges = kept(small.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "edges", before[0])
        discard(*used)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = after


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    """Most collisions to ask for that miss a pair at ``percent`` with less than ``MISS``."""
    p = percent / 100
    miss, m = 0.0, 0
    while m < coordinates:
        miss += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if miss >= MISS:
            break
        m += 1
    return max(1, m)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    percent: int = 85,
    shingle: int = SHINGLE,
    coordinates: int = COORDINATES,
    matches: int | None = None,
    short_list: int = SHORT_LIST,
) -> DataFrame:
    """``<row_id>, n_shingles, component_id, kept`` for every row of ``docs``."""
    matches = matches_for(percent, coordinates) if matches is None else matches
    kind = docs.schema[row_id].dataType.simpleString()
    source = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    sketched = stored(source.transform(mapped, _sketch(coordinates, shingle), f"id {kind}, n bigint, h1 bigint, h2 bigint, sig array<bigint>"), "sketches")

    usable = sketched.where("n > 0 and id is not null")
    classes = stored(usable.groupBy("h1", "h2", "n").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id")), "classes")
    posts = stored(_collision_posts(classes, matches), "collision-posts")
    long = posts.where(F.col("k") > short_list)
    pairs = stored(_short_pairs(posts.where(F.col("k") <= short_list), percent).union(_star_pairs(long, percent)).distinct(), "pairs")
    candidates = stored(collided(pairs, classes, matches), "candidates")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = likely(source, ids).join(ids, "id")
        return stored(wanted.transform(mapped, _sets(shingle), f"id {kind}, shingles array<bigint>"), "sets")

    links = stored(confirmed(candidates, sets_of(_ends(candidates)), percent), "links")
    so_far = stored(components(links), "components")

    # Members of long lists in several components: the skipped pairs may link them.
    labelled = long.select("id", "coordinate", "value").join(so_far, "id", "left").withColumn("c", F.coalesce("component", "id"))
    labelled = stored(labelled.select("id", "coordinate", "value", "c"), "labelled-lists")
    several = labelled.groupBy("coordinate", "value").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first != last")
    several = stored(several.select("coordinate", "value"), "open-lists")
    opened = stored(labelled.join(several, ["coordinate", "value"]).select("id").distinct(), "open-rows")
    if not opened.isEmpty():
        sets = sets_of(opened)
        listed = stored(_prefix_posts(sets, percent), "prefix-posts")
        for pairs_of in (_pivot_pairs, _apart_pairs):
            more = stored(pairs_of(_open_lists(listed, so_far, percent), percent), "more-pairs")
            more = stored(confirmed(more, sets, percent), "links")
            if not more.isEmpty():
                links = links.union(more)
                so_far = stored(components(links), "components")

    members = classes.join(so_far, "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    out = sketched.where("n > 0").select("id", "n", "h1", "h2").join(members, ["h1", "h2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    out = out.union(sketched.where("n = 0").select("id", "n", F.lit(None).cast(kind).alias("component")))
    leader = F.coalesce("component", "id")
    return out.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), leader.alias("component_id"), F.col("id").eqNullSafe(leader).alias("kept"))


def _ends(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "paired-rows")


def keep_one(docs: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that lead their component; columns stay as they are.

    Rows with a null id and blank texts stay.
    """
    gone = near_duplicates(docs, row_id=row_id, **options).where(~F.col("kept")).select(row_id)
    return docs.join(gone, row_id, "left_anti")


