"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words, weighted by how often the text has it and
by its inverse document frequency. Frequencies cover all documents; they are
kept for 2^18 hashed slots (a fixed size, as in feature hashing), while shingles
themselves keep 64-bit identities. SAMPLES consistent weighted samples of a
text form BANDS bands of ROWS each; texts that share a band are candidates.
With bands of 3 the chance that texts of similarity 0.8 share none of 14 is
4e-5. Candidates whose samples agree in fewer than AGREEING places are dropped
(below 1e-5 at 0.8); the others are verified by the weighted Jaccard similarity
of their whole texts. Classes are the connected components of verified links.

No group is expanded into pairs. Equal texts are one node, named by their MD5.
In each band's bucket all members are compared with two hubs only: the most
central node (whose buckets are the largest: what near copies were made from
shares bands with most of them) and a random one; and components are formed.
Buckets that then still hold several components are worked out further. There,
every node outside the bucket's largest component is compared with all others,
first by its samples (CROSSING must agree), then by FINE_SAMPLES more that only
such nodes get (FINE_AGREEING must; either leaves out 3e-4 of 0.8-similar
pairs). Of those in other components that can be similar enough its best two are
verified, in later rounds more (WINDOWS), in the last round all. What can be is
told by a bound: a text's
shingles are put in one order for all texts, rarest first, and what two texts
have in common begins with their first common shingle, so it weighs no more
than either text from there on. Where that is too little for the least
similarity the pair is passed over, without loss; only the shingles that can be
first (the leading fifth by weight) are needed to tell. So members that are soon
linked cost a few comparisons, and families of texts that share a frame but are
less similar cost comparisons of numbers, not of texts. A pair belongs to the first band that it shares and is proposed
in that bucket alone.

Buckets of up to SMALL members are one task's work. Larger ones are, in the
rounds before the last, split by one more sample of another band, SPLITS
overlapping ways, at most LEVELS times: that finds most links cheaply, but not
those of pairs that the splits part. In the last round larger buckets are not
split: members outside the largest component and all members are dealt into
blocks of about SMALL, and every block of the former meets every one of the
latter, so that no pair is left out.

A text of one to four words is one shingle of all its words. Wordless texts and
null texts are nobody's near duplicate; equal wordless texts are one class, null
texts are classes of their own row's id. class_id is the least doc_id of the
class (null only if all are). Each row gives one row, repeated ones too. Empty
tables give an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, let_go, map_slices, mix64, shingles_by_text, staged, word_hashes

SIMILARITY = 0.8
ROWS = 3
BANDS = 14
SAMPLES = ROWS * BANDS
AGREEING = 18
CROSSING = 24
FINE_SAMPLES = 200
FINE_AGREEING = 140
WINDOWS = (2, 16, None)
SLOTS = 1 << 18
SMALL = 2048
SPLITS = 3
LEVELS = 2
_SLACK = 1e-9  # for the rounding of sums
_TABLE = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(60):
        value = 1 - (1 + x) * np.exp(-x) - p
        x = np.maximum(x - np.clip(value / (x * np.exp(-x)), -0.5, 0.5), 1e-6)
    return x


_gamma = _gamma_quantiles()
_R, _INVERSE_R, _LOG_C = _gamma.astype(np.float32), (1 / _gamma).astype(np.float32), np.log(_gamma).astype(np.float32)
with np.errstate(over="ignore"):
    _EVERY_KEY = mix64(np.arange(1, SAMPLES + FINE_SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_KEYS, _FINE_KEYS = _EVERY_KEY[:SAMPLES], _EVERY_KEY[SAMPLES:]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + n) / (1 + documents with the slot)) + 1 of every slot, over all texts."""

    def run(batches):
        from .common import slices

        let_go()
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = word_hashes(part.column("text"))
                n += int((np.diff(offsets) > 0).sum())
                for shingles in shingles_by_text(hashes, offsets):
                    if len(shingles):
                        seen[np.unique((shingles & np.uint64(SLOTS - 1)).astype(np.int64))] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(SLOTS)
    n = int(counted.loc[counted["slot"] == -1, "n"].sum())
    counted = counted[counted["slot"] >= 0]
    frequency[counted["slot"]] = counted["n"]
    return np.log((1 + n) / (1 + frequency)) + 1


def weighted(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their weights."""
    distinct, counts = np.unique(shingles, return_counts=True)
    return distinct, counts * idf[(distinct & np.uint64(SLOTS - 1)).astype(np.int64)]


def samples(shingles: np.ndarray, weights: np.ndarray, keys: np.ndarray = _KEYS) -> np.ndarray:
    """One consistent weighted sample for each key as a 32-bit code: of the shingle and its quantised weight."""
    out = np.empty(len(keys), np.uint32)
    best = np.full(len(keys), np.inf, np.float32)
    for at in range(0, len(shingles), 1024):  # so many that the work stays in the processor's cache
        own = shingles[at : at + 1024]
        log_weight = np.log(weights[at : at + 1024]).astype(np.float32)
        with np.errstate(over="ignore"):
            drawn = own[None, :] ^ keys[:, None]
            drawn *= np.uint64(0xBF58476D1CE4E5B9)
            drawn ^= drawn >> np.uint64(32)
            drawn *= np.uint64(0x94D049BB133111EB)
        parts = drawn.view(np.uint16).reshape(*drawn.shape, 4)
        r_at, c_at = parts[..., 3], parts[..., 2]
        beta = parts[..., 1].astype(np.float32) * np.float32(2.0**-16)
        r = _R.take(r_at)
        step = np.floor(log_weight * _INVERSE_R.take(r_at) + beta)
        value = _LOG_C.take(c_at) - r * (step - beta + np.float32(1))
        pick = value.argmin(axis=1)
        rows = np.arange(len(keys))
        least = value[rows, pick]
        with np.errstate(over="ignore"):
            code = mix64(own[pick] + step[rows, pick].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        better = least < best
        best[better], out[better] = least[better], (code[better] >> np.uint64(32)).astype(np.uint32)
    return out


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles, weights)."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][at_a], b[1][at_b]).sum())
    total = float(a[1].sum() + b[1].sum()) - common
    return common / total if total > 0 else 0.0


def _signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, sketch (all sample codes), bands (their keys) of each row with words."""
    shipped = docs.sparkSession.sparkContext.broadcast(idf)
    spread = np.uint64(0x9E3779B97F4A7C15)

    def work():
        idf = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes, offsets = word_hashes(part.column("text"))
            kept = np.flatnonzero(np.diff(offsets) > 0)
            codes = np.empty((len(kept), SAMPLES), np.uint32)
            every = [s for s in shingles_by_text(hashes, offsets) if len(s)]
            for k, shingles in enumerate(every):
                codes[k] = samples(*weighted(shingles, idf))
            keys = np.zeros((len(kept), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(ROWS):
                    keys = mix64(keys * spread + codes[:, j::ROWS].astype(np.uint64) + np.uint64(1))
                keys += np.arange(BANDS, dtype=np.uint64) * spread
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            sketch = pa.array([c.tobytes() for c in codes], pa.binary())
            return pa.RecordBatch.from_arrays([part.column("node").take(pa.array(kept)), sketch, bands], ["node", "sketch", "bands"])

        return step

    return map_slices(docs, "text", work, "node string, sketch binary, bands array<long>")


def _agreement(a, b):
    """Sketch places that two binary columns share, JVM-side: their codes as hex, eight digits each."""
    places = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    return F.aggregate(places, F.lit(0), lambda n, k: n + F.when(F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4)), 1).otherwise(0))


def _verified(links: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The links (a, b) whose texts are similar enough."""
    shipped = links.sparkSession.sparkContext.broadcast(idf)
    pairs = links.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        idf, held, form = shipped.value, None, None

        def weights_of(text: str):
            hashes, offsets = word_hashes(pa.array([text], pa.string()))
            return weighted(next(shingles_by_text(hashes, offsets)), idf)

        for batch in batches:
            good = []
            for a, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != held:
                    held, form = a, weights_of(text_a.as_py())
                good.append(jaccard(form, weights_of(text_b.as_py())) >= least)
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes in links (a, b), by alternating large and small stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, older = None, []
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            discard(*older)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: greater neighbours move to the least of the neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: so do the lesser neighbours and the node itself
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        discard(*older)
        older = [edges, large]
        edges = staged(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def _hub_links(members: DataFrame) -> DataFrame:
    """In each bucket every member with the bucket's two hubs, if their sketches agree enough."""
    hubs = members.groupBy("bucket").agg(
        F.max(F.struct("central", "node", "sketch")).alias("first"), F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node", "sketch")).alias("second")
    )
    hubs = hubs.select("bucket", F.array(F.struct("first.node", "first.sketch"), F.struct("second.node", "second.sketch")).alias("hubs"))
    hubs = staged(hubs, "hubs")  # so that both sides of the join are shuffles, which Spark can split where a bucket is hot
    pairs = members.join(hubs, "bucket").select("node", "sketch", F.explode("hubs").alias("hub"))
    pairs = pairs.where(F.col("node") != F.col("hub.node"))
    pairs = pairs.where(_agreement(F.col("sketch"), F.col("hub.sketch")) >= AGREEING)
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets of several components, with their sizes."""
    kinds = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return staged(members.join(kinds.where("low <> high").select("bucket", "n"), "bucket"), "mixed")


def leading(shingles: np.ndarray, weights: np.ndarray, idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The shingles, rarest first, that can be the first common one of a similar pair; the weight from each on; and the whole weight."""
    order = np.lexsort((shingles, -idf[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)]))
    rest = np.cumsum(weights[order][::-1])[::-1]
    whole = float(rest[0]) if len(rest) else 0.0
    n = int(np.searchsorted(-rest, -least * whole * (1 - _SLACK), side="right"))
    return shingles[order[:n]], rest[:n], whole


class Leads:
    """The leading shingles of a group's texts, in one array."""

    def __init__(self, codes: list[bytes], rests: list[bytes], wholes: list[float]):
        self.offsets = np.concatenate([[0], np.cumsum([len(c) // 8 for c in codes])]).astype(np.int64)
        self.codes, self.rests = np.frombuffer(b"".join(codes), np.uint64), np.frombuffer(b"".join(rests), np.float64)
        self.wholes = np.array(wholes)

    def possible(self, k: int, others: Leads, near: np.ndarray, least: float) -> np.ndarray:
        """Which of the texts `near` of others can be as similar to text k as least."""
        if not len(near):
            return np.zeros(0, bool)
        a, b = self.offsets[k], self.offsets[k + 1]
        own, rests = self.codes[a:b], self.rests[a:b]
        order = np.argsort(own)
        starts, sizes = others.offsets[near], others.offsets[near + 1] - others.offsets[near]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))
        place = order[np.minimum(np.searchsorted(own, others.codes[at], sorter=order), max(len(own) - 1, 0))] if len(own) else np.zeros(len(at), np.int64)
        same = own[place] == others.codes[at] if len(own) else np.zeros(len(at), bool)
        none = len(at)
        first = np.full(len(near), none)
        hits = np.flatnonzero(same)
        np.minimum.at(first, np.repeat(np.arange(len(near)), sizes)[hits], hits)
        found = first < none
        first = np.minimum(first, max(none - 1, 0))
        needed = least / (1 + least) * (self.wholes[k] + others.wholes[near]) * (1 - _SLACK)
        return found & (np.minimum(rests[place[first]], others.rests[at[first]]) >= needed) if none and len(own) else found


def _fine_sketches(texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """node, fine: the further samples of each text, 16 bits each; lead, rest, whole: as leading gives them."""
    shipped = texts.sparkSession.sparkContext.broadcast(idf)

    def work():
        idf = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes, offsets = word_hashes(part.column("text"))
            fine, lead, rest, whole = [], [], [], []
            for shingles in shingles_by_text(hashes, offsets):
                form = weighted(shingles, idf)
                fine.append(samples(*form, _FINE_KEYS).astype(np.uint16).tobytes())
                codes, after, total = leading(*form, idf, least)
                lead.append(codes.tobytes())
                rest.append(after.astype(np.float64).tobytes())
                whole.append(total)
            columns = [part.column("node"), *(pa.array(c, pa.binary()) for c in (fine, lead, rest)), pa.array(whole, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["node", "fine", "lead", "rest", "whole"])

        return step

    return map_slices(texts, "text", work, "node string, fine binary, lead binary, rest binary, whole double")


def _cross_links(members: DataFrame, of: DataFrame, fine: DataFrame | None, texts: DataFrame, idf: np.ndarray, window: int | None, least: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Links to try between different components that share a bucket, `window` for each node (None if no bucket has several), and the fine sketches."""
    todo = _mixed(members.select("bucket", "band", "node", "sketch").join(of, "node", "left").select("bucket", "band", "node", "sketch", F.coalesce("component", "node").alias("component")))
    found = None
    if fine is None:
        fine = staged(_fine_sketches(texts.join(todo.select("node").distinct(), "node", "left_semi"), idf, least), "fine")

    def best(group: pa.Table) -> pa.Table:
        return _best_partners(group, window, least)

    for level in range(LEVELS + 1):
        if todo.isEmpty():
            break
        small = todo.where(F.col("n") <= SMALL) if level < LEVELS or window is None else todo
        links = small.select("bucket", "band", "node", "sketch", "component").join(fine, "node").groupBy("bucket").applyInArrow(best, "a string, b string").distinct()
        found = links if found is None else found.unionByName(links)
        if level < LEVELS:
            large = todo.where(F.col("n") > SMALL)
            if large.isEmpty():
                break
            if window is None:
                found = found.unionByName(_blocked_links(large, fine, least))
                break
            # samples of other bands: all members agree in those of their own
            ways = F.array(*[((F.col("band") + 1 + level) % BANDS * ROWS + j % ROWS).cast("int") for j in range(SPLITS)])
            split = todo.where(F.col("n") > SMALL).select(F.explode(ways).alias("k"), "bucket", "band", "node", "sketch", "component")
            todo = _mixed(split.select(F.xxhash64("bucket", "k", F.expr("substring(sketch, k * 4 + 1, 4)")).alias("bucket"), "band", "node", "sketch", "component"))
    return None if found is None else staged(found.distinct(), "cross"), fine


def _blocked_links(large: DataFrame, fine: DataFrame, least: float) -> DataFrame:
    """All pairs of members outside the largest component of their bucket with members of other components, in blocks."""
    held = large.groupBy("bucket", "component").agg(F.count("*").alias("held")).groupBy("bucket").agg(F.max(F.struct("held", "component")).alias("top"))
    held = staged(held.select("bucket", F.col("top.held").alias("held"), F.col("top.component").alias("largest")), "largest")
    rows = large.join(held, "bucket").select("bucket", "band", "node", "sketch", "component", (F.col("component") != F.col("largest")).alias("outside"), "n", "held")

    def blocks(n):
        return F.ceil(n / F.lit(SMALL)).cast("int")

    def own(n):
        return F.pmod(F.xxhash64("node"), blocks(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    few, columns = F.col("n") - F.col("held"), ("bucket", "band", "node", "sketch", "component")
    asking = rows.where("outside").select(*columns, own(few).alias("i"), F.lit(True).alias("asks"), every(F.col("n")).alias("j"))
    asked = rows.select(*columns, own(F.col("n")).alias("j"), F.lit(False).alias("asks"), every(few).alias("i"))
    dealt = asking.unionByName(asked).join(fine, "node")

    def partners(group: pa.Table) -> pa.Table:
        return _block_partners(group, least)

    return dealt.groupBy("bucket", "i", "j").applyInArrow(partners, "a string, b string").distinct()


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Leads | None]:
    """Nodes in order, their components, samples, further samples, and leading shingles if they are there."""
    nodes = np.array(group.column("node").to_pylist(), dtype=object)
    order = np.argsort(nodes)
    component = np.array(group.column("component").to_pylist(), dtype=object)[order]
    codes = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(len(nodes), SAMPLES)[order]
    fine = np.frombuffer(b"".join(group.column("fine").to_pylist()), np.uint16).reshape(len(nodes), FINE_SAMPLES)[order]
    leads = None
    if "lead" in group.column_names:
        lead, rest, whole = (group.column(c).to_pylist() for c in ("lead", "rest", "whole"))
        leads = Leads([lead[k] for k in order], [rest[k] for k in order], [whole[k] for k in order])
    return nodes[order], component, codes, fine, leads


def _alike(code: np.ndarray, fine: np.ndarray, codes: np.ndarray, fines: np.ndarray, near: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `near` those that agree enough with one node and share no earlier band with it, and how many further samples agree."""
    equal = codes[near] == code
    first = ~equal[:, : band * ROWS].reshape(len(near), band, ROWS).all(axis=2).any(axis=1)
    near = near[first & (equal.sum(axis=1) >= CROSSING)]
    same = (fines[near] == fine).sum(axis=1)
    return near[same >= FINE_AGREEING], same[same >= FINE_AGREEING]


def _pairs(nodes: list[tuple[str, str]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in nodes], pa.string()), "b": pa.array([b for _, b in nodes], pa.string())})


def _block_partners(group: pa.Table, least: float) -> pa.Table:
    """Of each asking node in a block all partners among the asked ones of other components."""
    asks = group.column("asks")
    nodes, component, codes, fine, leads = _columns(group.filter(asks))
    others, other_component, other_codes, other_fine, other_leads = _columns(group.filter(pc.invert(asks)))
    band, found = group.column("band")[0].as_py(), set()
    for k in range(len(nodes)):
        near, _ = _alike(codes[k], fine[k], other_codes, other_fine, np.flatnonzero(other_component != component[k]), band)
        if leads:
            near = near[leads.possible(k, other_leads, near, least)]
        found.update((min(nodes[k], others[j]), max(nodes[k], others[j])) for j in near.tolist())
    return _pairs(sorted(found))


def _best_partners(group: pa.Table, window: int | None, least: float) -> pa.Table:
    """Of each member outside the bucket's largest component, its best partners in other components, of the pairs whose first shared band this is."""
    nodes, component, codes, fine, leads = _columns(group)
    component = np.unique(component, return_inverse=True)[1]
    band = group.column("band")[0].as_py()
    largest = np.bincount(component).argmax()
    found = set()
    for k in np.flatnonzero(component != largest).tolist():
        near, same = _alike(codes[k], fine[k], codes, fine, np.flatnonzero(component != component[k]), band)
        if leads:
            can = leads.possible(k, leads, near, least)
            near, same = near[can], same[can]
        found.update((min(k, j), max(k, j)) for j in near[np.argsort(-same, kind="stable")][:window].tolist())
    return _pairs([(nodes[a], nodes[b]) for a, b in sorted(found)])


def _node():
    return F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary")))


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of docs: (node, component) of every text, and (component, class_id, class_size, kept: the node and id that stand for it)."""
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    idf = inverse_frequencies(rows)
    texts = rows.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(_signatures(texts.select("node", "text"), idf), "signatures")
    # copies fall together here; min is the same for all of them
    members = signed.groupBy("node").agg(F.min("sketch").alias("sketch"), F.min("bands").alias("bands")).select(F.posexplode("bands").alias("band", "bucket"), "node", "sketch")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(members.join(shared, "bucket"), "shared")
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    members = staged(members.select("bucket", "band", "node", "sketch").join(central, "node"), "members")
    links = staged(_hub_links(members), "links")
    by_text = staged(texts.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "by_text")
    # the text of one row per candidate: keyed by node and id, so that a hot text's copies stay apart
    absent = F.lit(-(1 << 62))
    chosen = by_text.join(members.select("node").distinct(), "node", "left_semi").select("node", F.coalesce("first_id", absent).alias("doc_id"))
    kept = texts.select("node", F.coalesce("doc_id", absent).alias("doc_id"), "text").join(chosen, ["node", "doc_id"], "left_semi")
    kept = staged(kept.dropDuplicates(["node"]).select("node", "text"), "texts")
    good = staged(_verified(links, kept, idf, least), "good")
    of = staged(components(good), "components")
    tested, fine = links, None
    for window in WINDOWS:
        more, fine = _cross_links(members, of, fine, kept, idf, window, least)
        if more is None:
            break
        fresh = staged(more.join(tested, ["a", "b"], "left_anti"), "fresh")
        further = staged(_verified(fresh, kept, idf, least), "good")
        tested = tested.unionByName(fresh)
        if not further.isEmpty():
            stars = of.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what is known, and what joins it
            of = staged(components(stars.unionByName(further)), "components")
    by_text = by_text.join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first_id", "n")
    # an absent id is the last choice for a class
    first = F.min(F.struct(F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("order"), "node", "first_id"))
    classes = by_text.groupBy("component").agg(first.alias("kept"), F.sum("n").alias("class_size"))
    return by_text.select("node", "component"), staged(classes.select("component", F.col("kept.first_id").alias("class_id"), "class_size", F.col("kept.node").alias("kept_node")), "classes")


def duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size for each row of docs."""
    of, classes = _classes(docs, least)
    known = of.join(classes, "component").select("node", "class_id", "class_size")
    named = docs.select("doc_id", _node().alias("node"))
    return named.join(known, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def one_of_each_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each class of docs one row, of the least doc_id, with all its columns; null texts all stay."""
    _, classes = _classes(docs, least)
    absent = F.lit(-(1 << 62))
    held = {c.lower() for c in docs.columns}
    free = next(f"__{k}" for k in range(len(held) + 1) if not any(c.startswith(f"__{k}_") for c in held))
    node, own = f"{free}_node", f"{free}_id"
    chosen = classes.select(F.col("kept_node").alias(node), F.coalesce("class_id", absent).alias(own))
    keyed = docs.withColumns({node: _node(), own: F.coalesce(F.col("doc_id").cast("long"), absent)})
    kept = keyed.where(F.col("text").isNotNull()).join(chosen, [node, own], "left_semi")
    narrow = keyed.where(F.col("text").isNotNull()).groupBy(node, own).agg(F.count("*").alias("n"))
    if not narrow.where("n > 1").isEmpty():  # rows of equal id and text
        kept = kept.dropDuplicates([node, own])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("text").isNull()))
