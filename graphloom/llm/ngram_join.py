"""N-gram Jaccard self-join: which documents are near copies, exactly, by token groups.

Documents with the same shingle set count once.  Then

1. *Groups.*  Each set votes, by a few minimal hashes, for a set that looks like it, and is
   compared with that one; links make the first groups of similar sets, so that thousands of
   near copies become one group with one comparison each.
2. *Token-group matrix.*  A token's row says which groups hold it (a group holds the union of its
   sets' tokens).  For a set of ``n`` tokens at most ``n - ceil(t n)`` may be missing from a
   partner.  So, over a fixed prefix of its tokens in hash order, a set with a partner outside
   its group has at least so many tokens that other groups hold; sets below the bound are done.
   For the rest the bound is taken over all their tokens, against each other, until no more
   sets leave.
3. *Opening.*  What is left is cut into groups of similar sets once more, each packed in one row with
   its token union.  A set goes to the groups that hold one of its rarest tokens among theirs; its
   overlap with the union bounds its overlap with any member, and only a group that can reach
   the least overlap is opened.  Of two groups of linked sets the smaller one asks.

Nothing is sampled or capped: links missed by step 1 are found by 2 and 3.  Set rows are spread
by document or token, and tokens of all documents are never kept at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import as_bytes, numbered, numbering, slices
from graphloom.llm.components import components
from graphloom.llm.decontaminate import mixed, window_hashes, word_codes
from graphloom.operators.indexing import with_row_index
from graphloom.session import append, fresh_path, materialize, remove

WORDS, LIKE = 5, 75  # words in a shingle; the least similarity in hundredths
TURNS = 3  # rounds of first comparisons; what they miss is found later
KEYS = 4  # minimal hashes that vote for a set's group
BROADCAST_ROWS = 400_000  # some 100 bytes each; of longer tables a range of rows at a time
PER_LOT = 128  # sets compared with a voted set in one piece of work
PER_GROUP, LONG_SET = 1024, 1 << 16  # sets packed into one group to be opened; bytes of a long one, which counts 16
PER_OPENING = 2048  # sets that meet a group in one piece of work
BUCKET_TOKENS = 2_000_000


def token_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    table = numbering()
    parts = [numbered(table, t.lower().split()) for t in texts]
    codes = word_codes(list(table)) if len(table) else np.zeros(0, np.uint64)
    out = []
    for part in parts:
        size = min(words, len(part))
        found = window_hashes(codes[part], size) if size else np.zeros(0, np.uint64)
        if 0 < len(part) < words:
            found = mixed(found + np.uint64(len(part)))
        found.sort()
        out.append(found[np.diff(found, prepend=found[:1] + np.uint64(1)) != 0] if len(found) else found)
    return out


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n, like: int = LIKE):
    """A partner shares at least this many of n tokens."""
    return -(-like * n // 100)


def _depth(n):
    """Shared tokens that a prefix must show: 1 more for each 8 tokens of a set."""
    return 1 + n // 8


def prefix_length(n, like: int = LIKE):
    return n - least_overlap(n, like) + _depth(n)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n, digest, keys`` of ``docs(doc_id, row, text)``: one row per row."""
    seeds = mixed(np.arange(1, KEYS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sets = token_sets(as_bytes(part.column(2)))
                keys = [
                    [int(mixed(s ^ k).min().astype(np.int64)) for k in seeds] if len(s) else []
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "row", "n", "digest", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, row long, n long, digest binary, keys array<long>")


def _from_texts(
    docs: DataFrame, wanted: DataFrame, columns: Sequence[str], work: Callable, schema: str, spent: list[str]
) -> DataFrame:
    """What ``work`` makes of ``text`` and ``columns`` of the rows in ``wanted(row, ...)``.

    Texts are never shuffled: ``wanted`` is broadcast.  If it is long, a range of rows goes after the
    other, and what is made of them is gathered in a table, whose path is added to ``spent``.
    """

    def made(docs: DataFrame, wanted: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(wanted), "row").select("text", *columns).mapInArrow(work, schema)

    many = wanted.count()
    if many <= BROADCAST_ROWS:
        return made(docs, wanted)
    parts = -(-many // BROADCAST_ROWS)
    cuts = wanted.agg(F.percentile_approx("row", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    path = fresh_path(docs.sparkSession, "from-texts")
    for low, high in pairwise([None, *sorted(set(cuts)), None]):
        # Rows lie in the order of their numbers, so a range reads its own part of the texts.
        here = F.lit(True) if low is None else F.col("row") > low
        here = here if high is None else here & (F.col("row") <= high)
        append(made(docs.filter(here), wanted.filter(here)), path)
    spent.append(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _votes(sets: DataFrame, like: int, turn: int) -> DataFrame:
    """``q, m, g``: each set and the set of another group it most looks like, by minimal hashes
    they share; another ``turn`` proposes other sets."""
    keys = sets.select("rn", "n", "grp", F.posexplode("keys").alias("k", "key"))
    first = keys.groupBy("k", "key").agg(
        F.min_by(F.struct("rn", "n", "grp"), F.xxhash64("rn", F.lit(turn))).alias("m"),
        (F.min("grp") != F.max("grp")).alias("apart"),
    )
    met = keys.join(first.filter("apart").drop("apart"), ["k", "key"]).filter("grp <> m.grp")
    fits = met.filter(F.least("n", "m.n") * 100 >= F.greatest("n", "m.n") * like)
    counted = fits.groupBy(F.col("rn").alias("q"), F.col("m.rn").alias("m")).count()
    best = counted.groupBy("q").agg(F.max(F.struct("count", -F.col("m"))).alias("best"))
    return best.select("q", (-F.col("best.col2")).alias("m"), (-F.col("best.col2")).alias("g"))


def _grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with ``grp``: the component by ``links``, or the set itself."""
    own = sets.drop("grp").join(components(links).withColumnRenamed("node", "rn"), "rn", "left")
    own = own.withColumn("grp", F.coalesce("component", "rn")).drop("component")
    return materialize(own, "groups")


def verified(
    docs: DataFrame, sets: DataFrame, queries: DataFrame, members: DataFrame, like: int, spent: list[str]
) -> DataFrame:
    """``a, b``: the pairs of a query and a member of a group that link, from ``queries(q, g)``
    and ``members(m, g)``.

    A group's members and its queries meet in lots of about ``PER_LOT`` queries.  A query is
    compared with members only if its overlap with the union of their tokens is large enough.
    """
    sizes = queries.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PER_LOT).alias("lots"))
    queries = queries.join(sizes, "g").select(
        F.col("q").alias("rn"), "g", F.pmod(F.xxhash64("q"), F.col("lots")).alias("lot"), F.lit(1).alias("role")
    )
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot")
    members = members.join(sizes, "g").select(F.col("m").alias("rn"), "g", lots, F.lit(0).alias("role"))
    known = sets.select("rn", "row", "digest")
    wanted = materialize(members.unionByName(queries).join(known, "rn"), "destinations")

    def tokens(batches):
        names = ["g", "lot", "role", "rn", "tokens"]
        for batch in batches:
            for part in slices(batch, 0):
                digests, sets = as_bytes(part.column(1)), token_sets(as_bytes(part.column(0)))
                # A row number that stands for several texts: only the right one counts.
                right = pa.array([digest(s) == d for s, d in zip(sets, digests, strict=True)])
                value = pa.array([s.tobytes() for s in sets], pa.binary())
                out = pa.RecordBatch.from_arrays([*part.columns[2:], value], names=names)
                yield out.filter(right)

    schema = "g long, lot long, role int, rn long, tokens binary"
    rows = _from_texts(docs, wanted, ["digest", "g", "lot", "role", "rn"], tokens, schema, spent)
    spread = rows.repartition("g", "lot")

    def compare(batches):
        here, members, union = None, {}, None
        for batch in batches:
            left, right = [], []
            for g, lot, role, rn, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(raw, np.uint64)
                if (g, lot) != here:
                    here, members, union = (g, lot), {}, None
                if role == 0:
                    members[rn] = mine
                    continue
                if union is None and members:
                    union = np.unique(np.concatenate(list(members.values())))
                if union is None or _shared(mine, union) * 100 < like * len(mine):
                    continue
                for m, other in members.items():
                    small, large = sorted((len(mine), len(other)))
                    if m == rn or 100 * small < like * large:
                        continue
                    both = _shared(mine, other)
                    if 100 * both >= like * (len(mine) + len(other) - both):
                        left.append(rn)
                        right.append(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    ordered = spread.sortWithinPartitions("g", "lot", "role", "rn")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _outside_counts(docs: DataFrame, sets: DataFrame, length, buckets: int, spent: list[str]) -> DataFrame:
    """``rn, shared``: of the first ``length(n)`` tokens of each set of ``sets(row, digest, rn,
    grp)``, how many stand also among those of a set in another group.

    Tokens travel in packed blocks: per block and bucket the sets' numbers, groups and counts,
    and 48 bits of each token; a collision can only keep a set that could have left.  A token
    that several groups of a block hold is counted there, and only two of its sets tell others of
    it, so a passage that most texts share is no hot key.  Answers are packed per block too,
    and added up there.
    """

    def pack(batches):
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def close():
            numbers = np.array([(r, g) for r, g, _ in held], np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(held)), [len(t) for _, _, t in held])
            flat = np.concatenate([t for _, _, t in held])
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            group = numbers[owner, 1]
            begins = np.flatnonzero(np.diff(flat, prepend=flat[:1] + np.uint64(1)) != 0)
            times = np.diff(begins, append=len(flat))
            ends = [np.repeat(f.reduceat(group, begins), times) for f in (np.minimum, np.maximum)]
            apart = ends[0] != ends[1]
            here = np.bincount(owner[apart], minlength=len(held))
            told, run = ~apart, np.repeat(np.arange(len(begins)), times)
            for end in ends:  # the first set of each end's group
                some = np.flatnonzero(apart & (group == end))
                told[some[np.diff(run[some], prepend=-1) != 0]] = True
            owner, flat, known = owner[told], flat[told], apart[told]
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            block = int(numbers[0, 0])
            for b in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[b] : bounds[b + 1]]
                short = flat[mine] >> np.uint64(16)
                begins = np.flatnonzero(np.diff(owner[mine], prepend=-1))
                who = owner[mine][begins]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(b)], pa.int32()),
                        pa.array([block], pa.int64()),
                        pa.array([numbers[who].tobytes()], pa.binary()),
                        pa.array([np.diff(begins, append=len(mine)).astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([short.astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([(short >> np.uint64(32)).astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([np.packbits(known[mine]).tobytes()], pa.binary()),
                    ],
                    names=["bucket", "block", "sets", "counts", "low", "high", "known"],
                )
            # What the block knows by itself goes to no bucket.
            some = np.flatnonzero(here)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1], pa.int32()), pa.array([block], pa.int64()),
                    pa.array([numbers[some, 0].tobytes()], pa.binary()),
                    pa.array([here[some].astype(np.uint32).tobytes()], pa.binary()),
                    *(pa.array([b""], pa.binary()) for _ in range(3)),
                ],
                names=["bucket", "block", "sets", "counts", "low", "high", "known"],
            )

        for batch in batches:
            for part in slices(batch, 0):
                found = token_sets(as_bytes(part.column(0)))
                known = zip(*(c.to_pylist() for c in part.columns[1:]), found, strict=True)
                for right, rn, grp, tokens in known:
                    if digest(tokens) == right:
                        kept = tokens[: length(len(tokens))]
                        held.append((rn, grp, kept))
                        size += len(kept)
                if size > BUCKET_TOKENS:
                    yield from close()
                    held, size = [], 0
        if size:
            yield from close()

    def count(batches):
        names, parts = ["block", "sets", "counts"], []
        for batch in batches:
            for b in range(batch.num_rows):
                bucket, block, *row = (batch.column(i)[b].as_py() for i in range(7))
                if bucket < 0:
                    values = [pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in row[:2])]
                    yield pa.RecordBatch.from_arrays(values, names=names)
                    continue
                numbers = np.frombuffer(row[0], np.int64).reshape(-1, 2)
                counts = np.frombuffer(row[1], np.uint32)
                token = np.frombuffer(row[2], np.uint32).astype(np.uint64)
                token |= np.frombuffer(row[3], np.uint16).astype(np.uint64) << np.uint64(32)
                known = np.unpackbits(np.frombuffer(row[4], np.uint8), count=len(token)).astype(bool)
                parts.append((block, numbers, counts, token, known))
        if not parts:
            return
        token = np.concatenate([p[3] for p in parts])
        known = np.concatenate([p[4] for p in parts])
        group = np.concatenate([np.repeat(p[1][:, 1], p[2]) for p in parts])
        order = np.argsort(token)
        ordered = token[order]
        begins = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)) != 0)
        group = group[order]
        apart = np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins)
        many = np.zeros(len(token), bool)
        many[order] = np.repeat(apart, np.diff(begins, append=len(token)))
        many &= ~known  # counted at home
        at = 0
        for block, numbers, counts, tokens, _ in parts:
            mine = many[at : at + len(tokens)]
            at += len(tokens)
            shared = np.bincount(np.repeat(np.arange(len(numbers)), counts)[mine], minlength=len(numbers))
            some = np.flatnonzero(shared)
            if len(some):
                values = [numbers[some, 0].tobytes(), shared[some].astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=names
                )

    def add(key, table):
        numbers = np.concatenate([np.frombuffer(v, np.int64) for v in table["sets"].to_pylist()])
        counts = np.concatenate([np.frombuffer(v, np.uint32) for v in table["counts"].to_pylist()])
        rn, at = np.unique(numbers, return_inverse=True)
        return pa.table({"rn": rn, "shared": np.bincount(at, counts, len(rn)).astype(np.int64)})

    wanted = sets.select("row", "digest", "rn", "grp")
    schema = "bucket int, block long, sets binary, counts binary, low binary, high binary, known binary"
    # A block's own counts are dealt anywhere.
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    packs = _from_texts(docs, wanted, ["digest", "rn", "grp"], pack, schema, spent)
    blocks = packs.withColumn("place", place).repartitionById(buckets, "place").drop("place")
    answers = blocks.mapInArrow(count, "block long, sets binary, counts binary")
    return answers.groupBy("block").applyInArrow(add, "rn long, shared long")


def _still_open(docs: DataFrame, sets: DataFrame, length, need) -> DataFrame:  # functions of n
    """The rows of ``sets`` whose shared tokens reach ``need(n)``, written to a table."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    total = length(int(total))  # near enough for the sum of the prefixes
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(total) // BUCKET_TOKENS + 1)
    spent: list[str] = []
    counts = _outside_counts(docs, sets, length, buckets, spent)
    kept = sets.join(counts, "rn").filter(F.col("shared") >= need(F.col("n")))
    return _written(kept.drop("shared"), "open-sets", spent)


def _written(df: DataFrame, label: str, spent: list[str]) -> DataFrame:
    """``df`` as a table, without those at ``spent``, which only ``df`` read."""
    table = materialize(df, label)
    for path in spent:
        remove(df.sparkSession, path)
    return table


def _rare_prefixes(open_sets: DataFrame, like: int) -> DataFrame:
    """``rn, token``: of each set of ``open_sets(rn, tokens)`` so many of its rarest tokens that two sets
    which link have one of them in common.

    A passage that many sets hold brings none of them together: its tokens come last.  A token of a single
    set stands before all others and meets nothing, so it is counted and left out.
    """

    def tokens(batches):
        for batch in batches:
            for rn, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(value, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine), v)) for v in (rn, len(mine))] + [pa.array(mine)],
                    names=["rn", "n", "token"],
                )

    flat = open_sets.select("rn", "tokens").mapInArrow(tokens, "rn long, n long, token long")
    many = F.count(F.lit(1)).over(Window.partitionBy("token"))
    shared = flat.withColumn("many", many).filter("many > 1")
    listed = F.array_sort(F.collect_list(F.struct("many", "token"))).alias("listed")
    whole = shared.groupBy("rn").agg(F.first("n").alias("n"), listed)
    length = F.size("listed") - F.ceil(F.col("n") * like / 100) + 1
    first = F.slice("listed", 1, F.greatest(length, F.lit(0)).cast("int"))
    return whole.select("rn", F.explode(first.getField("token")).alias("token"))


def _opened(docs: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """``a, b``: groups of ``sets`` with sets that link, found by opening packed groups."""
    wanted = sets.select("row", "digest", "rn", "grp")
    # Groups ask larger ones only; ``rank`` orders them.
    ranked = wanted.join(
        sets.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).select(
            "grp", F.struct("size", "grp").alias("rank")
        ), "grp",
    )
    ranked = materialize(ranked.select("row", "digest", "rn", "grp", "rank.size"), "open-ranks")

    def tokens(batches):
        names = ["rn", "grp", "size", "first", "tokens"]
        for batch in batches:
            for part in slices(batch, 0):
                found = token_sets(as_bytes(part.column(0)))
                right = pa.array([digest(t) == d for t, d in zip(found, as_bytes(part.column(1)), strict=True)])
                first = pa.array([int(t[0]) >> 1 if len(t) else 0 for t in found], pa.int64())
                value = pa.array([t.tobytes() for t in found], pa.binary())
                out = pa.RecordBatch.from_arrays([*part.columns[2:5], first, value], names=names)
                yield out.filter(right)

    spent: list[str] = []
    schema = "rn long, grp long, size long, first long, tokens binary"
    open_sets = _from_texts(docs, ranked, ["digest", "rn", "grp", "size"], tokens, schema, spent)
    open_sets = open_sets if spent else materialize(open_sets, "open-tokens")
    # Similar sets mostly have the same smallest token; a group's sets stay together.
    lead = open_sets.groupBy("grp").agg(F.min("first").alias("lead"))
    near = open_sets.join(lead, "grp").withColumn("long", F.octet_length("tokens") > LONG_SET)
    placed = with_row_index(near, ["long", "lead", "grp", "rn"], "place")
    many = F.when(F.col("long"), F.lit(PER_GROUP // 16)).otherwise(F.lit(PER_GROUP))
    pack_of = F.struct("long", F.floor(F.col("place") / many))

    def packed(key, table):
        ids = np.stack([table[c].to_numpy().astype(np.int64) for c in ("rn", "grp", "size")], axis=1)
        parts = [np.frombuffer(v, np.uint64) for v in table["tokens"].to_pylist()]
        flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(t) for t in parts])
        order = np.argsort(flat, kind="stable")
        size, grp = max((int(s), int(g)) for _, g, s in ids)
        values = [ids, np.array([len(t) for t in parts], np.int64), flat[order], owner[order].astype(np.uint16)]
        columns = [pa.array([int(ids[0, 0])], pa.int64()), *(pa.array([v], pa.int64()) for v in (size, grp))]
        columns += [pa.array([v.tobytes()], pa.binary()) for v in values]
        return pa.Table.from_arrays(columns, names=["g", "size", "grp", "ids", "sizes", "tokens", "owners"])

    packs = placed.select(pack_of.alias("pack"), "rn", "grp", "size", "tokens").groupBy("pack").applyInArrow(
        packed, "g long, size long, grp long, ids binary, sizes binary, tokens binary, owners binary"
    )
    packs = materialize(packs, "open-groups")

    def members(batches):
        for batch in batches:
            for g, size, grp, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rn = np.frombuffer(ids, np.int64).reshape(-1, 3)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rn), *(pa.array(np.full(len(rn), v)) for v in (g, size, grp))],
                    names=["rn", "g", "most_size", "most_grp"],
                )

    prefixes = materialize(_rare_prefixes(open_sets, like), "open-prefixes")
    asks = prefixes.join(ranked.select("rn", "grp", "size"), "rn")
    held = packs.select("g", "size", "grp", "ids").mapInArrow(members, "rn long, g long, most_size long, most_grp long")
    holds = prefixes.join(held, "rn").drop("rn").distinct()
    larger = F.struct("most_size", "most_grp") > F.struct("size", "grp")
    met = asks.join(holds, "token").filter(larger).select("rn", "g").distinct()
    met = materialize(met, "open-meetings")
    lots = met.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PER_OPENING).alias("lots"))
    queries = met.join(lots, "g").join(open_sets, "rn").select(
        "g", F.pmod(F.xxhash64("rn"), F.col("lots")).alias("lot"), F.lit(1).alias("role"), "rn", F.col("grp").alias("q_grp"), F.col("size").alias("q_size"),
        F.col("tokens").alias("q_tokens"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot")
    groups = packs.drop("size", "grp").join(lots, "g").select("*", every, F.lit(0).alias("role")).drop("lots")
    meeting = groups.unionByName(queries, allowMissingColumns=True)

    def compare(batches):
        here = None
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["role"] == 0:
                    here = row["g"]
                    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 3)
                    sizes, tokens = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["tokens"], np.uint64)
                    owners = np.frombuffer(row["owners"], np.uint16).astype(np.int64)
                    continue
                if row["g"] != here:
                    raise ValueError("a set came without its group")
                mine = np.frombuffer(row["q_tokens"], np.uint64)
                begin = np.searchsorted(tokens, mine, side="left")
                many = np.searchsorted(tokens, mine, side="right") - begin
                # The overlap with the group's union bounds that with any member.
                if np.count_nonzero(many) * 100 < like * len(mine):
                    continue
                both = np.bincount(owners[gather_places(begin, many)], minlength=len(ids))
                linked = 100 * both >= like * (len(mine) + sizes - both)
                for other in np.unique(ids[linked, 1]).tolist():
                    if other != row["q_grp"]:
                        left.append(row["q_grp"])
                        right.append(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    ordered = meeting.repartition("g", "lot").sortWithinPartitions("g", "lot", "role", "rn")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def gather_places(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``begins[i], begins[i] + 1, …``, ``counts[i]`` of them for each i."""
    upto = np.cumsum(counts)
    total = int(upto[-1]) if len(upto) else 0
    return np.repeat(begins - (upto - counts), counts) + np.arange(total)


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", like: int = LIKE, row: str | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Two documents link when their shingle sets have ``100 * intersection >= like * union``;
    ``component_id`` is the smallest id that links reach.  Null, empty and wordless texts have an
    empty set and link with nothing.  Rows with the same id are one document with all its texts;
    rows without id get no component and link nothing.  An empty table gives no rows.

    ``row`` names a column of numbers, no two equal, in whose order a written table lies.  Without it
    a long table is copied once with such numbers.
    """
    number = F.col(doc_id if row is None else row).cast("long").alias("row")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), number, F.col(text).alias("text"))
    if row is None and docs.count() > BROADCAST_ROWS:
        docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    rows = materialize(shingle_sets(docs), "shingle-sets")
    sets = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    sets = materialize(sets.withColumn("rn", F.monotonically_increasing_id()), "sets")
    grouped, links = sets.withColumn("grp", F.col("rn")), None
    for turn in range(TURNS):
        alike = materialize(_votes(grouped, like, turn), "votes")
        members = alike.select("m", "g").distinct()
        spent: list[str] = []
        found = verified(docs, sets, alike.select("q", "g"), members, like, spent)
        found = _written(found, "links", spent)
        links = found if links is None else links.union(found)
        grouped = _grouped(sets, links)
    links = docs.sparkSession.createDataFrame([], "a long, b long") if links is None else links
    still = grouped.drop("keys")
    still = _still_open(docs, still, prefix_length, lambda n: 1 + F.floor(F.ceil(n * like / 100) / 8))
    left = still.count()
    while left:
        still = _still_open(docs, still, lambda n: n, lambda n: F.ceil(n * like / 100))
        before, left = left, still.count()
        if left > 0.9 * before:
            break
    if left:
        grouped = _grouped(sets, links.union(materialize(_opened(docs, still, like), "links")))
    smallest = grouped.groupBy("grp").agg(F.min("rep").alias("component_id"))
    classes = grouped.join(smallest, "grp").select("digest", "component_id")
    # The same id with several texts: its smallest component holds for all of them.
    out = rows.join(classes, "digest", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"),
    )
