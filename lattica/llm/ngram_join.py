"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same set of 5-word shingles form a class; classes are the rows of the incidence matrix. The
columns (64-bit shingle hashes) are dealt into blocks. A block's task finds the columns with entries in two rows or
more and the partial overlap counts are added up over blocks; a pair is dropped when its count is below the bound
that the sizes imply, and every remaining pair is verified on the whole sets.

So that a large group of near copies does not make all its pairs, the product is taken between components only:

1. classes that share a band of min-hashes are verified against one leader of the band (rows linear in the
   documents) and the links are closed to components;
2. a class enters the product with its smallest hashes (a prefix that must hold at least a quarter of the required
   overlap), and only columns that occur in two different components count. A class of which too few entries are
   left cannot link to another component and is dropped; the others enter with all their columns, with the bound
   that their size sets;
3. classes that share one of their rare columns meet in tiles of bounded size; a tile takes the product, adding up
   overlaps column by column, and puts out only links that join two components; these are closed again.

Step 2 and 3 miss no link between components, and links within a component do not change it, so the result is exact
whatever step 1 finds.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a null doc_id is linked
with nothing and has a null component; repeated rows stay, each with its result; rows of one doc_id with different
texts are one document as far as components go; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import U64, bounded_broadcast, give_back, mix, parallelism, small_batches, stage, starts_of, texts_of, unstage
from lattica.llm.components import components

WORDS, PERCENT = 5, 75
#: Bands of two min-hashes each.
BANDS = 6
#: Documents handled at once, entries sent at once, words whose hash is kept.
ROWS, ENTRIES, KEPT_WORDS = 256, 400_000, 100_000
#: Classes of a block in the product, about.
TILE = 512
#: Entries of a column block, about, and entries that wait in a task before they are sorted.
BLOCK, HELD = 4_000_000, 4_000_000
_MULTIPLY = (mix(np.arange(1, 65, dtype=U64)) | U64(1))
PROFILE = "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>"


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ``bytes`` lower and split by exactly the ASCII rules asked for."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    at = starts_of(counts)
    flat = np.empty(int(at[-1]), dtype=U64)
    get = _HASHES.__getitem__
    for w, i, j in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True):
        flat[i:j] = np.fromiter(map(get, w), dtype=U64, count=j - i)
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - width + 1)
        total = np.zeros(n, dtype=U64)
        for k in range(width):
            total += flat[k : k + n] * _MULTIPLY[k]
        hashed = mix(total)
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= width:
                own = np.sort(hashed[i : j - width + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif j > i:
                out.append(mix(np.array([(flat[i:j] * _MULTIPLY[: j - i]).sum(dtype=U64) + U64(j - i) * _MULTIPLY[60]], dtype=U64)))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(np.frombuffer(raw, np.int64).tolist())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)
    give_back()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        sets = shingle_sets(texts_of(batch.column(1)))
        full = [s for s in sets if len(s)]
        keys = iter(())
        if full:
            flat, at = np.concatenate(full), starts_of(np.array([len(s) for s in full]))[:-1]
            with np.errstate(over="ignore"):
                least = [np.minimum.reduceat(flat * _MULTIPLY[8 + k], at) for k in range(2 * BANDS)]
                bands = np.stack([mix(least[2 * b] * _MULTIPLY[40] + least[2 * b + 1] + U64(b)) for b in range(BANDS)], axis=1)
            keys = iter(bands.view(np.int64).tolist())
        classes = [class_of(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in classes], pa.int64()), pa.array([b for _, b in classes], pa.int64()), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "class_a", "class_b", "bands"],
        )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def needed(n: np.ndarray | int):
    """The least overlap that a set of n shingles has with any set it links to: ceil(0.75 n)."""
    return (n * PERCENT + 99) // 100


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets at least PERCENT / 100."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) * 100 < len(b) * PERCENT:
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both * 100 >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (leader, salt), leaders first: (leader, salt, follows, doc_id, class_a, text) to linked pairs."""
    at, lead = None, None
    for batch in _chunks(batches):
        sets = shingle_sets(texts_of(batch.column(5)))
        x, y = [], []
        for own, (leader, salt, follows, doc_id, class_a) in zip(sets, zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True), strict=True):
            if class_of(own)[0] != class_a:  # another text of the same doc_id
                continue
            if not follows:
                at, lead = (leader, salt), own
            elif at == (leader, salt) and linked(lead, own):
                x.append(doc_id)
                y.append(leader)
        yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones among ``pairs`` (a, class_a, b, class_b of documents): x, y.

    The texts go to (leader, salt) groups; a leader with many partners is repeated for each of its salts.
    """
    n = pairs.count()
    salts = max(16, n // 100_000)
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    wanted = pairs.select(F.col("b").alias("doc_id"), F.col("class_b").alias("class"), F.col("a").alias("leader"), "salt", F.lit(1).alias("follows")).unionByName(
        pairs.select(F.col("a").alias("doc_id"), F.col("class_a").alias("class"), F.col("a").alias("leader"), "salt", F.lit(0).alias("follows")).distinct()
    )
    rows = _rows(docs).join(bounded_broadcast(wanted, 2 * n), "doc_id")
    rows = rows.repartition(parallelism(docs.sparkSession), "leader", "salt").sortWithinPartitions("leader", "salt", "follows")
    return rows.select("leader", "salt", "follows", "doc_id", "class", "text").mapInArrow(_verify, "x long, y long")


def _packed(hashes: list[np.ndarray], owners: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """Entries (column, class) as one row per column block."""
    h, c = np.concatenate(hashes), np.concatenate(owners)
    block = (h % U64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    h, c, block = h[order], c[order], block[order]
    there, at = np.unique(block, return_index=True)
    ends = np.append(at[1:], len(h))
    return pa.RecordBatch.from_pydict({"block": pa.array(there, pa.int64()), "columns": [h[i:j].tobytes() for i, j in zip(at, ends, strict=True)], "classes": [c[i:j].tobytes() for i, j in zip(at, ends, strict=True)]})


def _prefixes(blocks: int):
    """Documents to entries of the incidence matrix, packed by column block; a batch sends an entry once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0
        for batch in _chunks(batches):
            for s in shingle_sets(texts_of(batch.column(0))):
                if not len(s) or (own := class_of(s)) in seen:
                    continue
                seen.add(own)
                n = len(s)
                cut = s[: n - needed(n) + max(1, n // 4)]
                hashes.append(cut)
                owners.append(np.full(len(cut), own[0], dtype=np.int64))
                held += len(cut)
            if held >= ENTRIES:
                yield _packed(hashes, owners, blocks)
                hashes, owners, held = [], [], 0
                seen.clear()
        if held:
            yield _packed(hashes, owners, blocks)

    return run


class _Block:
    """The entries of one column block, of which only those of columns that one class has so far are held.

    What comes from a column that two classes or more have goes out as it comes, so a column that all classes have
    costs its hash. An entry that is given again after it went out goes out again.
    """

    def __init__(self) -> None:
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.held = np.zeros(0, U64), np.zeros(0, np.int64)
        self.known = np.zeros(0, U64)

    def add(self, h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.wait.append((h, c))
        self.waiting += len(h)
        if self.waiting >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        h, c = (np.concatenate([self.held[k], *(x[k] for x in self.wait)]) for k in (0, 1))
        self.wait, self.waiting = [], 0
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)]
        h, c = h[first], c[first]
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        if len(self.known):
            twice |= self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        self.held = h[~twice], c[~twice]
        h, c = h[twice], c[twice]
        self.known = np.union1d(self.known, h)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_pydict({"column": pa.array(h[i : i + 100_000].view(np.int64)), "class_a": pa.array(c[i : i + 100_000])})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each column block, the entries of columns that two classes or more have."""
    at: int | None = None
    own = _Block()
    for batch in batches:
        for block, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if block != at:
                yield from own.out()
                at, own = block, _Block()
            yield from own.add(np.frombuffer(h, U64), np.frombuffer(c, np.int64))
    yield from own.out()
    del own
    give_back()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (class_a, text) the rows whose text is of that class, not another text of the same doc_id."""
    for batch in _chunks(batches):
        own = [class_of(s)[0] == a for a, s in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch.column(1))), strict=True)]
        yield batch.filter(pa.array(own, pa.bool_()))


def _entire(blocks: int):
    """(class_a, text) to all entries of the class, packed by column block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0
        for batch in _chunks(batches):
            for own, s in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch.column(1))), strict=True):
                if class_of(s)[0] == own:
                    hashes.append(s)
                    owners.append(np.full(len(s), own, dtype=np.int64))
                    held += len(s)
            if held >= ENTRIES:
                yield _packed(hashes, owners, blocks)
                hashes, owners, held = [], [], 0
        if held:
            yield _packed(hashes, owners, blocks)

    return run


def _across(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """The entries (column, class_a) with their class, of columns that occur in two components, and how often (df)."""
    rows = entries.join(classes.select("class_a", "rep", "n", "component"), "class_a").select("column", "rep", "n", "component")
    ends = rows.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df"))
    return rows.join(ends.where("lo < hi").select("column", "df"), "column")


def _between(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes of different components, enough to join all that are linked: x, y.

    ``classes``: rep, n, class_a, component. First all classes meet by their prefixes, and a class of which fewer
    entries are shared with other components than the least prefix overlap is out. The others meet by all their
    entries; one that shares fewer than the overlap any partner needs is out. Of the rest, linked pairs share one of
    the entries that come first when rare columns go first; classes that hang together by such columns meet in tiles
    of two blocks, where the product is taken and only links come out.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    packed, entry = "block long, columns binary, classes binary", "column long, class_a long"
    meet = lambda rows: rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_shared, entry)
    # an entry of the prefixes may come from each copy of a class, an entry of all comes once
    blocks = lambda entries: max(4 * n, -(-int(entries or 0) // BLOCK))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    first = stage(meet(docs.select("text").mapInArrow(_prefixes(blocks(classes.agg(F.sum(prefix * F.col("rows"))).first()[0])), packed)), "entries")
    # a partner of the least size has the least quarter overlap
    some = F.col("count") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / 4))
    alive = stage(classes.join(_across(first, classes).groupBy("rep", "n").count().where(some).select("rep"), "rep"), "alive")
    unstage(first)
    ids = bounded_broadcast(alive.select(F.col("rep").alias("doc_id"), "class_a"), alive.count())
    texts = _rows(docs).where(F.col("doc_id").isNotNull()).join(ids, "doc_id").select("class_a", "text")
    texts = texts.mapInArrow(_own, "class_a long, text string").dropDuplicates(["class_a"])
    every = stage(meet(texts.mapInArrow(_entire(blocks(alive.agg(F.sum("n")).first()[0])), packed)), "entries")
    least = F.ceil(F.col("n") * PERCENT / 100)
    for again in (False, True):  # classes that are out may leave columns to one component
        last = [alive, shared] if again else [alive]
        shared = stage(_across(every, alive), "shared")
        enough = shared.groupBy("rep", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("rep", "shared")
        alive = stage(alive.select("rep", "n", "class_a", "component").join(enough, "rep"), "alive")
        unstage(*last)
    unstage(every)
    rare = Window.partitionBy("rep").orderBy("df", "column")
    kept = shared.join(alive.select("rep", "class_a", "shared"), "rep").withColumn("place", F.row_number().over(rare))
    kept = stage(kept.where(F.col("place") <= F.col("shared") - least + 1).select("column", "rep"), "rare")
    # classes that share a rare column, directly or by others, meet in tiles
    ends = kept.groupBy("column").agg(F.min("rep").alias("y"), F.count("*").alias("k")).where("k > 1").select("column", "y")
    meeting = stage(components(kept.join(ends, "column").select(F.col("rep").alias("x"), "y")), "meeting")
    # blocks hold classes of like size: linked ones differ by a step at most
    step = F.floor(F.log("n") / float(np.log(100 / PERCENT)) + 1e-9).cast("long").alias("step")
    members = meeting.withColumnRenamed("node", "rep").join(alive.select("rep", "n", "component"), "rep").select("root", "rep", "n", "component", step)
    # both are read several times below; the driver plans anew after every shuffle, so a plan that holds each once a use costs it memory
    met = members = stage(members, "members")
    sizes = stage(members.groupBy("root", "step").agg(F.ceil(F.count("*") / TILE).alias("blocks")), "sizes")
    near = [sizes.select("root", (F.col("step") - d).alias("step"), F.col("blocks").alias(name)) for d, name in ((-1, "below"), (0, "own"), (1, "above"))]
    for x in near:
        members = members.join(x, ["root", "step"], "left")
    number = lambda step, place: F.shiftleft(step, 32) + place
    upto = lambda name: F.when(F.col(name).isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    members = members.withColumn("block", number(F.col("step"), F.pmod(F.xxhash64("rep"), F.col("own"))))
    # a block meets those of its own step and of the steps beside it, and stands on the side of its number
    numbered = lambda name, step: F.transform(upto(name), lambda x: number(step, x))
    others = F.concat(*[numbered(name, F.col("step") + d) for d, name in ((-1, "below"), (0, "own"), (1, "above"))])
    members = members.select("root", "rep", "n", "component", "block", others.alias("others"))
    columns = shared.join(met.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_list("column").alias("columns"))
    tiles = columns.join(members, "rep").withColumn("other", F.explode("others")).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "component", "columns"
    )
    out = stage(tiles.groupBy("root", "low", "high").applyInArrow(_tile, "x long, y long"), "links")
    unstage(shared, alive, kept, meeting, met, sizes)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of sets: rare columns pair by pair, frequent ones as dense products by blocks."""
    owner = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)])
    side = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    column = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    order = np.lexsort((owner, side, column))
    column, owner, side = column[order], owner[order], side[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    of = [np.bincount(column[side == s], minlength=n) for s in (0, 1)]
    both = of[0] * of[1]
    rows = [(column[side == s], owner[side == s]) for s in (0, 1)]
    rare = (both > 0) & (both <= 64)
    # every entry on the left with all entries on the right of its column
    at = starts_of(of[1])
    c, i = (x[rare[rows[0][0]]] for x in rows[0])
    many = of[1][c]
    j = np.repeat(at[c] - starts_of(many)[:-1], many) + np.arange(int(many.sum()))
    np.add.at(out, (np.repeat(i, many), rows[1][1][j]), 1)
    dense = np.flatnonzero(both > 64)
    place = np.full(n, -1)
    place[dense] = np.arange(len(dense))
    for k in range(0, len(dense), 2048):
        a, b = (np.zeros((m, 2048), dtype=np.float32) for m in out.shape)
        for matrix, (c, i) in ((a, rows[0]), (b, rows[1])):
            p = place[c]
            keep = (p >= k) & (p < k + 2048)
            matrix[i[keep], p[keep] - k] = 1
        out += a @ b.T
    return out.astype(np.int64)


def _tile(key, table):  # Spark tells grouped functions apart by their hints
    """Links between the classes of two blocks of one meeting, as few as join what they join.

    Sizes bound the overlap that a pair needs; pairs of one component are not asked for, nor are pairs that links
    found before have joined.
    """
    low, high = key[1].as_py(), key[2].as_py()
    block, rep, n, component = (table.column(c).to_numpy() for c in ("block", "rep", "n", "component"))
    sets = [x.values.to_numpy() for x in table.column("columns")]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    both = overlaps([sets[i] for i in left], [sets[i] for i in right])
    a, b = n[left][:, None], n[right][None, :]
    good = (both * 100 >= PERCENT * (a + b - both)) & (component[left][:, None] != component[right][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    x, y = [], []
    for i, j in zip(*np.nonzero(good), strict=True):
        p, q = find(int(component[left[i]])), find(int(component[right[j]]))
        if p != q:
            root[p] = q
            x.append(int(rep[left[i]]))
            y.append(int(rep[right[j]]))
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def _stars(classes: DataFrame) -> DataFrame:
    """Each class with the leader of each of its bands: a, class_a, b, class_b."""
    keyed = classes.select("rep", "n", "class_a", F.posexplode("bands").alias("band", "key"))
    lead = keyed.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("rep", "band").alias("o"), "rep", "n", "class_a")).alias("l"), F.count("*").alias("k"))
    lead = stage(lead.where("k > 1").select("band", "key", F.col("l.rep").alias("a"), F.col("l.n").alias("na"), F.col("l.class_a").alias("lead_class")), "leaders")
    met = keyed.join(lead, ["band", "key"]).where((F.col("a") != F.col("rep")) & sizes_fit(F.col("n"), F.col("na")))
    out = stage(met.select("a", F.col("lead_class").alias("class_a"), F.col("rep").alias("b"), F.col("class_a").alias("class_b")).distinct(), "stars")
    unstage(lead)
    return out


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    small_batches(docs.sparkSession)
    profile = stage(_rows(docs).mapInArrow(_profile, PROFILE), "profile")
    full = profile.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = full.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count("*").alias("rows"))
    classes = stage(classes, "classes")
    stars = _stars(classes)
    known = stage(verify(docs, stars), "links")
    unstage(stars)
    # documents that have several texts tie their classes together
    several = full.groupBy("doc_id").agg(F.min("class_a").alias("lo"), F.max("class_a").alias("hi")).where("lo <> hi").select("doc_id")
    rep_of = full.join(several, "doc_id").join(classes.select("class_a", "class_b", "rep"), ["class_a", "class_b"])
    edges = known.unionByName(rep_of.select(F.col("doc_id").alias("x"), F.col("rep").alias("y")))
    roots = stage(components(edges), "roots")
    of = lambda roots: classes.join(roots, F.col("rep") == F.col("node"), "left").select("class_a", "class_b", "rep", "n", "rows", F.coalesce("root", "rep").alias("component"))
    now = stage(of(roots), "components")
    more = _between(docs, now)
    final = now
    if not more.isEmpty():  # the roots are stars already, so closing them again takes few rounds
        stars_now = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
        final = stage(of(stage(components(stars_now.unionByName(more)), "roots")), "components")
        unstage(now)
    unstage(more, known, roots, classes)
    out = profile.join(final.select("class_a", "class_b", "component"), ["class_a", "class_b"], "left")
    linked_to = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", linked_to.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each component, with all its columns; documents without id or shingles stay.

    Of several rows of one doc_id the first by text stays, a null text before others. That text is found with map-side
    partial minima, and of rows that agree in id and text one is kept in the same way, so no task holds all rows of an
    id. Extra columns may have any name.
    """
    found = stage(link_documents(docs), "linked")
    again = stage(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = stage(found.where("doc_id is null or component_id = doc_id").select("doc_id").distinct(), "kept")
    kept = bounded_broadcast(kept, kept.count())  # the texts are shuffled only where there are many ids
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("document"), F.col("doc_id").cast("long").alias("id"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    if again.isEmpty():
        return out.select("document.*")
    several = out.join(again, F.col("id") == F.col("doc_id"), "left_semi")
    text = F.struct(F.col("document.text").isNotNull().alias("there"), F.col("document.text").alias("text"))
    first = several.groupBy("id").agg(F.min_by("document", F.struct(text, F.xxhash64(F.to_json("document")))).alias("document"))
    return out.join(again, F.col("id") == F.col("doc_id"), "left_anti").select("document.*").unionByName(first.select("document.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) t ON t.a = d.doc_id
"""
