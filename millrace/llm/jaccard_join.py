"""N-gram Jaccard join by a token-group matrix.

Exact self-join of word-shingle sets at a Jaccard threshold, as classes of equal sets, links
between classes and connected components:

1. Equal sets become one class, so a group of copies of any size counts once from here on.
   Classes have numbers of their own, so ids that repeat can't mix up what they stand for.
2. Each class gets bucket tokens (:class:`millrace.llm._shingles.Buckets`); classes without
   a common token are proven dissimilar. Only tokens of two classes or more are kept.
3. First grouping: classes that lead to the same leader by their tokens form a cluster, and
   are held against the leader. What links forms groups. Clusters, and groups too large for
   them, are cut into blocks of bounded size.
4. Token-group matrix: the distinct (token, block) cells. Two blocks that share a token, and
   aren't of one group, meet: the union of shingles of a block bounds the overlap of a query
   with any member, and only a block whose bound reaches the threshold is opened for it and
   its members counted exactly.
5. Connected components over all links.

A link within a group is never needed again, and documents travel by blocks, not by pairs; no
link between different groups is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, connected_components, fresh, in_slices, lookup, materialize
from millrace.llm._shingles import Buckets, mix, shingle_sets

#: Members of a block and their shingles, on average at most; groups have as many blocks as they need.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 20
#: Ratio of the largest to the smallest set in a band of sizes.
SIZE_BAND = 1.08
#: Up to so many classes are broadcast to pick a text for each; more go by a shuffled join.
BROADCAST_IDS = 1_000_000
#: A token that stands this often among the classes looked at is dealt over TOKEN_SALTS tasks.
HOT_TOKEN, LOOKED_AT, TOKEN_SALTS = 64, 1 << 16, 64


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, text): ``tid``, a digest of the text, tells rows of one id apart."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.select("id", _tid(F.col("text")).alias("tid"), "text")


def _tid(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _profiles(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, tid, n, digest, probes) of every document; equal sets of shingles have one digest."""

    def run(batches):
        buckets = Buckets(num, den)
        for batch in in_slices(batches):
            n, digest, probes = [], [], []
            for h in shingle_sets(batch.column(2), width):
                n.append(len(h))
                digest.append(_digest(h))
                probes.append(buckets.probes(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(probes, pa.binary())],
                names=["id", "tid", "n", "digest", "probes"],
            )

    return docs.mapInArrow(run, "id long, tid binary, n int, digest binary, probes binary")


def _sets(met: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles) of rows (cls, digest, text) whose text has that digest; ``id`` is the class."""

    def run(batches):
        for batch in in_slices(batches):
            rows = [
                (c, len(h), h.tobytes())
                for c, d, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), width))
                if _digest(h) == d
            ]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], names=["id", "n", "shingles"]
            )

    return met.mapInArrow(run, "id long, n int, shingles binary")


def _postings(classes: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, id, salt) for each probe of each class; ``salt`` deals the classes of the tokens in ``hot``, sorted, and is 0 for others."""

    def run(batches):
        for batch in in_slices(batches):
            tokens = [np.frombuffer(p, dtype=np.int64) for p in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(t) for t in tokens])
            all_tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            salt = np.where(_among(all_tokens, hot), mix(ids.astype(np.uint64)) % np.uint64(TOKEN_SALTS), np.uint64(0)).astype(np.int32)
            for i in range(0, len(ids), 100_000):
                cols = (x[i : i + 100_000] for x in (all_tokens, ids, salt))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["token", "id", "salt"])

    return classes.select("id", "probes").mapInArrow(run, "token long, id long, salt int")


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in ``few``, which is sorted."""
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x if len(few) else np.zeros(len(x), dtype=bool)


def _hot_tokens(classes: DataFrame, number: int) -> np.ndarray:
    """Tokens that stand at least HOT_TOKEN times among about LOOKED_AT of the classes, sorted: how rows are dealt, never what comes out.

    They are bounded by the probes of that many classes over HOT_TOKEN.
    """
    every = max(1, number // LOOKED_AT)
    some = _postings(classes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), np.empty(0, np.int64))
    found = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_TOKEN).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], dtype=np.int64))


def _shared(postings: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, id) of the postings whose token two classes or more have.

    Tokens come together by one shuffle, hot ones dealt over several tasks by class, and are
    read as a sorted stream: a row is told by its neighbours, so memory is bounded by a batch
    however long a run is. Hot tokens have many classes as it is.
    """
    dealt = postings.repartition("token", "salt").select("token", "id").sortWithinPartitions("token", "id")

    def run(batches):
        before, held = None, None  # token of the row before the held one; the held row

        def told(token, ids, last_next):
            same_next = np.concatenate((token[1:] == token[:-1], [last_next]))
            same_prev = np.concatenate(([before is not None and before == token[0]], token[1:] == token[:-1]))
            keep = same_next | same_prev | _among(token, hot)
            return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ids[keep])], names=["token", "id"])

        for batch in batches:
            token, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held is not None:
                token, ids = np.concatenate(([held[0]], token)), np.concatenate(([held[1]], ids))
            if len(token) > 1:
                yield told(token[:-1], ids[:-1], token[-1] == token[-2])
                before = token[-2]
            if len(token):
                held = (token[-1], ids[-1])
        if held is not None:
            yield told(np.array([held[0]], np.int64), np.array([held[1]], np.int64), False)

    return dealt.mapInArrow(run, "token long, id long")


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def _parts(blocks: DataFrame) -> DataFrame:
    """(pblock, parts): how many tasks the rows (block, n, ...) of a block are dealt to, where there are more than one.

    That is one row for BLOCK_MEMBERS or BLOCK_SHINGLES at most, so the table is small against the
    rows, and Spark broadcasts it up to its own threshold; beyond, the adaptive planner splits
    the partitions of hot blocks.
    """
    much = F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)
    return blocks.groupBy(F.col("block").alias("pblock")).agg(F.ceil(much).cast("int").alias("parts")).where("parts > 1")


def _star_links(sets: DataFrame, stars: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the stars (block, id, n): of a leader, whose id is the block's, and a member."""
    parts = _parts(stars)
    with_parts = lambda df: df.join(parts, F.col("block") == F.col("pblock"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    member = with_parts(stars).select("block", F.expr("pmod(xxhash64(id), parts)").cast("int").alias("part"), "id")
    leader = with_parts(stars.select("block").distinct())
    leader = leader.select("block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("block").alias("id"))
    rows = member.unionByName(leader).join(sets.select("id", "shingles"), "id")

    def run(key, frame):
        import pandas as pd

        sets_of = {i: np.frombuffer(x, dtype=np.uint64) for i, x in zip(frame["id"], frame["shingles"])}
        lead = sets_of.pop(key[0], None)
        found = [(key[0], i) for i, h in sets_of.items() if lead is not None and _similar(lead, h, num, den)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("block", "part").applyInPandas(run, "a long, b long")


def _block_links(sets: DataFrame, blocked: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the members (id, grp) of the blocks of each pair (qblock, block).

    Members of ``qblock`` query ``block``. Returned are links enough to join all groups that any
    link joins; pairs of members whose groups are joined already are passed over.
    """
    side = blocked.select(F.col("block").alias("side"), "id", "grp", "n")
    other = F.expr("if(qblock = block, array(struct(block as side, lo, hi)), array(struct(block as side, qlo as lo, qhi as hi), struct(qblock as side, lo, hi)))")
    each = pairs.select("qblock", "block", F.inline(other))
    # Only members whose size allows a link with some size on the other side travel.
    fits = (F.col("n") * den >= F.col("lo") * num) & (F.col("hi") * den >= F.col("n") * num)
    rows = each.join(side, "side").where(fits).select("qblock", "block", "side", "id", "grp").join(sets.select("id", "shingles"), "id")

    def run(key, frame):
        import pandas as pd

        sets_of = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
        ids, groups, sides = (frame[c].tolist() for c in ("id", "grp", "side"))
        members = [i for i in range(len(ids)) if sides[i] == key[1]]
        queries = [i for i in range(len(ids)) if sides[i] == key[0]]
        if not members or not queries:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        up = {g: g for g in groups}

        def root(g):
            while up[g] != g:
                up[g] = up[up[g]]
                g = up[g]
            return g

        # The group's part of the token matrix: its union of shingles, and which members hold each.
        sizes = np.array([len(sets_of[i]) for i in members])
        flat = np.concatenate([sets_of[i] for i in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        links = []
        for q in queries:
            h = sets_of[q]
            lo, hi = np.searchsorted(flat, h, side="left"), np.searchsorted(flat, h, side="right")
            held = hi > lo
            if den * int(held.sum()) < num * len(h):
                continue  # the union's overlap bounds that with any member: closed for this query
            lo, hi = lo[held], hi[held]
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(members))
            for k in np.flatnonzero(den * common >= num * (len(h) + sizes - common)).tolist():
                m = members[k]
                x, y = root(groups[q]), root(groups[m])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((ids[q], ids[m]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("qblock", "block").applyInPandas(run, "a long, b long")


def _labelled(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, tid, n, component, first_tid) of every document with shingles and an id, and (id, n) of all others.

    (component, first_tid) is the smallest (id, tid) of the document's component.
    """
    spark, spent = df.sparkSession, []
    docs = _documents(df, id_col, text_col)
    profiles = materialize(_profiles(docs, width, num, den), "jaccard-profiles", "lz4")
    filled = profiles.where("n > 0 and id is not null")
    # The smallest (id, tid) of a class names the text that stands for it.
    classes = filled.groupBy(F.col("digest").alias("hd")).agg(
        F.min(F.struct("id", "tid")).alias("one"), F.first("n").alias("n"), F.first("probes").alias("probes")
    )
    classes = classes.select("hd", F.col("one.id").alias("head"), F.col("one.tid").alias("htid"), "n", "probes", F.monotonically_increasing_id().alias("cls"))
    classes = materialize(classes, "jaccard-classes", "lz4", spent)
    linked = _class_components(docs, classes, width, num, den, spent).select(F.col("id").alias("cid"), F.col("component").alias("root"))
    heads = classes.select("hd", F.struct("head", "htid").alias("own"), "cls")
    told = materialize(heads.join(linked, F.col("cls") == F.col("cid"), "left").select("hd", "own", "root"), "jaccard-roots", spent=spent)
    in_some = told.where("root is not null")
    least = in_some.groupBy(F.col("root").alias("lroot")).agg(F.min("own").alias("first"))
    least = materialize(least, "jaccard-least", spent=spent)
    labels = lookup(in_some, "root", least, "lroot").select("hd", "first")
    labels = labels.unionByName(told.where("root is null").select("hd", F.col("own").alias("first")))
    labels = materialize(labels.select("hd", F.col("first.head").alias("component"), F.col("first.htid").alias("first_tid")), "jaccard-labels")
    rows = lookup(filled.select("id", "tid", "n", "digest"), "digest", labels, "hd")
    clear(spark, spent)
    others = profiles.where("n = 0 or id is null").select("id", "n")
    return rows.select("id", "tid", "n", "component", "first_tid"), others


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; exact.

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable over links.

    Defined results: null, empty or blank texts have no shingles and are components of their
    own; repeated rows each give a row of one component; rows that repeat an id with other
    texts are documents of their own, each with the component of its own text; a row with a
    null id links with nothing and has a null component; equal sets always link; an empty
    table gives none; other columns are not read. Ids must be integers.
    """
    rows, others = _labelled(df, id_col, text_col, width, num, den)
    of = lambda part, component: part.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col(component).alias("component_id"))
    return of(rows, "component").unionByName(of(others, "id"))


def _class_components(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int, spent: list[str]) -> DataFrame:
    """(id, component) of the classes that link with another, by their numbers."""
    probed = classes.select(F.col("cls").alias("id"), "probes")
    hot = _hot_tokens(probed, classes.count())
    shared = materialize(_shared(_postings(probed, hot), hot).distinct(), "jaccard-shared", "lz4", spent)
    ids = materialize(shared.select("id").distinct(), "jaccard-ids", spent=spent)
    # Each class's text is found by a hash of (id, tid) and told by its digest.
    wanted = classes.join(ids, F.col("cls") == F.col("id"), "left_semi").select(F.xxhash64("head", "htid").alias("at"), "cls", "hd")
    wanted = materialize(wanted, "jaccard-wanted", "lz4", spent)
    n = wanted.count()
    met = docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.xxhash64("id", "tid") == F.col("at")).select("cls", "hd", "text")
    sets = materialize(_sets(met, width), "jaccard-sets", "lz4", spent)
    if sets.count() > n:  # rows that repeat an id and a text
        sets = materialize(sets.dropDuplicates(["id"]), "jaccard-sets", "lz4", spent)

    # Similar classes share leaders; each goes by the one of the smallest hash among its tokens'.
    # A token that many classes have is a large key of this join, whose partition the adaptive planner splits.
    leader = shared.groupBy("token").agg(F.min_by("id", F.xxhash64("id")).alias("leader"))
    cluster = shared.join(leader, "token").groupBy("id").agg(F.min_by("leader", F.xxhash64("leader")).alias("block"))
    cluster = materialize(cluster.join(sets.select("id", "n"), "id"), "jaccard-clusters", spent=spent)
    first = materialize(_star_links(sets, cluster.where("id <> block"), num, den), "jaccard-links", spent=spent)
    grouped = connected_components(first, "jaccard-groups", spent)

    blocked = materialize(_into_blocks(cluster, grouped), "jaccard-blocks", spent=spent)
    extent = blocked.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # Cells of the matrix; tokens that stand in one group only can tell nothing new.
    cells = shared.join(blocked, "id")
    several = cells.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    matrix = materialize(cells.join(several, "token").select("token", "block", "own").distinct(), "jaccard-matrix", "lz4", spent)
    other = matrix.select("token", F.col("block").alias("qblock"), F.col("own").alias("qown"))
    pairs = matrix.join(other, "token").where("qblock <= block and (own is null or qown is null or own <> qown)")
    pairs = pairs.select("qblock", "block").distinct().join(extent, "block")
    pairs = pairs.join(extent.select(F.col("block").alias("qblock"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi")), "qblock")
    near = (F.col("hi") * den >= F.col("qlo") * num) & (F.col("qhi") * den >= F.col("lo") * num)
    pairs = materialize(pairs.where(near), "jaccard-pairs", spent=spent)
    second = _block_links(sets, blocked, pairs, num, den)
    return connected_components(
        grouped.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second),
        "jaccard-components",
        spent,
    )


def _into_blocks(cluster: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, n, grp, own, block): blocks of similar classes, of BLOCK_MEMBERS and BLOCK_SHINGLES at most on average.

    A large group fills blocks of its own (``own`` is its id); small groups and classes
    without a link share the blocks of their cluster. What is too large for one block is
    cut by set size first, so that many pairs of blocks are ruled out by their sizes. Blocks
    go by 64-bit hashes; two meet with probability 2**-64, and then both are compared together.
    """
    group = cluster.join(grouped, "id", "left").select("id", "n", "block", F.coalesce("component", "id").alias("grp"))
    large = group.groupBy(F.col("grp").alias("own")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= BLOCK_MEMBERS // 4).select("own")
    block = F.when(F.col("own").isNull(), F.xxhash64("block", F.lit("cluster"))).otherwise(F.xxhash64("grp", F.lit("group")))
    out = group.join(large, F.col("grp") == F.col("own"), "left").select("id", "n", "grp", "own", block.alias("block"))
    band = F.floor(F.log(F.col("n")) / math.log(SIZE_BAND))
    for cut in (band, F.pmod(F.xxhash64("id"), F.col("parts"))):
        split = F.when(F.col("parts").isNotNull(), F.xxhash64("block", cut)).otherwise(F.col("block"))
        out = out.join(_parts(out), F.col("block") == F.col("pblock"), "left").select("id", "n", "grp", "own", split.alias("block"))
    return out


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df``, same columns, of which one of each component is kept: the one of the smallest id, then text digest.

    Defined results: rows with a null id, and null, empty or blank texts, are all kept; of
    rows that repeat an id with other texts each is judged by its own text, so a text that is
    like no other always stays; of rows that repeat both id and text one stays, whichever; an
    empty table gives an empty one; other columns, of whatever name, are passed on.
    """
    rows, _ = _labelled(df, id_col, text_col, width, num, den)
    gone, i, t = fresh(df, "__gone", "__id", "__tid")
    other = (F.col("id") != F.col("component")) | (F.col("tid") != F.col("first_tid"))
    told = rows.groupBy("id", "tid", other.alias(gone)).agg(F.count(F.lit(1)).alias("times"))
    told = told.where(F.col(gone) | (F.col("times") > 1)).select(F.col("id").alias(i), F.col("tid").alias(t), gone)
    told = materialize(told, "jaccard-told")
    same = (F.col(id_col).cast("long") == F.col(i)) & (_tid(F.col(text_col).cast("string")) == F.col(t))
    out = df.join(told, same, "left")
    single = out.where(F.col(gone).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    several = out.where(~F.col(gone))
    if told.where(~F.col(gone)).isEmpty():
        return single
    return single.unionByName(several.dropDuplicates([i, t]).select(*[F.col(f"`{c}`") for c in df.columns]))
