"""N-gram Jaccard self-join by T-occurrence search, and its connected components."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, filter_bits, mix64, parted, small, small_batches, staged, unused
from .shared import find_shared
from .tokens import shingle_set, slices, windows, words

#: Shingles in at least so many documents form the later classes of the global order.
LEVELS = (2, 8, 64)
#: Lists up to this length are searched pair by pair at once.
SHORT = 4
#: Partners of one query that are searched together, and nodes of a block.
GROUP = 256
#: Lists of more than a block have further turns, of so many stars a list, while a turn leaves this percentage of their nodes
#: outside the largest labels at most.
STARS, LEFT = 8, 80


def need(a, b, percent: int):
    """The least intersection of sets of a and b elements with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int = 80) -> np.ndarray:
    """Indices of the sets that reach the overlap with query that their sizes ask for.

    T-occurrence search by DivideSkip: the inverted lists of the query's tokens over `sets` are divided into
    the L longest ones and the others. The short lists are heap-merged, which counts each set; a set that
    reaches T - L is then looked up in the long lists by binary search, and stays if it reaches T.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    t_of = need(len(query), sizes, percent)
    least = int(t_of.min())
    tokens = np.concatenate(sets)
    ids = np.repeat(np.arange(len(sets)), sizes)
    at = np.searchsorted(query, tokens)
    hit = at < len(query)
    hit[hit] = query[at[hit]] == tokens[hit]
    at, ids = at[hit], ids[hit]
    order = np.argsort(at, kind="stable")  # list by list, ids ascending in each
    at, ids = at[order], ids[order]
    length = np.bincount(at, minlength=len(query))
    start = np.cumsum(length) - length
    longest = int(length.max()) if len(length) else 0
    n_long = min(int(least / (0.0085 * np.log2(max(2, longest)) + 1)), max(0, least - 1), len(query))
    by_length = np.argsort(-length, kind="stable")
    lists = [ids[start[k] : start[k] + length[k]] for k in by_length]
    counts = np.zeros(len(sets), np.int64)
    for i in heapq.merge(*[x.tolist() for x in lists[n_long:] if len(x)]):
        counts[i] += 1
    found = np.flatnonzero(counts >= t_of - n_long)
    for n, part in enumerate(lists[:n_long]):
        found = found[counts[found] >= t_of[found] - (n_long - n)]
        if not len(found):
            break
        p = np.searchsorted(part, found)
        p_in = p < len(part)
        p_in[p_in] = part[p[p_in]] == found[p_in]
        counts[found[p_in]] += 1
    return found[counts[found] >= t_of[found]]


def _named(shingles: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit names of the sets shingles[at[i]:at[i + 1]]: two sums of hashes that have nothing in common, with the size."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    out: list[bytes | None] = [None] * len(size)
    if len(some):
        n = size[some].astype(np.uint64)
        sums = [np.add.reduceat(mix64(shingles ^ np.uint64(c)), at[some]) for c in (0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)]
        raw = np.stack([mix64(sums[0] + n), mix64(sums[1] - n)], 1).tobytes()
        for k, i in enumerate(some.tolist()):
            out[i] = raw[16 * k : 16 * k + 16]
    return out


def node_of(shingles: np.ndarray) -> bytes:
    return _named(shingles, np.array([0, len(shingles)]))[0]


def _sets(column, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """The shingle sets of a column: sorted hashes text by text, offsets, and the names."""
    w = words(column, lower=True)
    whole = windows(w.hash, k)
    sets = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        sets.append(np.unique(whole[a : b - k + 1]) if b - a >= k else shingle_set(w.hash[a:b], k))
    at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return tokens, at, _named(tokens, at)


def _fresh(column, k: int, seen: set):
    """The sets of a column that this task didn't have yet (a bounded memory of names: a speed-up only)."""
    if len(seen) > 100_000:
        seen.clear()
    for some in slices(column):
        tokens, at, names = _sets(some, k)
        for i, name in enumerate(names):
            if name is not None and name not in seen:
                seen.add(name)
                yield tokens[at[i] : at[i + 1]]


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, node, n, skip, prefix): prefix has the shared ones among the first n - T + 1 shingles in the global order.

    skip counts those before them, which no other document has.

    Any set that links has T = ceil(percent * n / 100) of the n shingles, so it has one of those.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def fresh(column):
        return _fresh(column, k, seen)

    seen: set = set()
    shared = find_shared(docs, fresh, LEVELS)

    def run(batches):
        import pyarrow as pa

        for b in (x for batch in batches for x in slices(batch, 1)):
            tokens, at, names = _sets(b.column(1), k)
            level = shared(tokens)
            often = np.flatnonzero(level)
            n = np.diff(at)
            cut = np.searchsorted(often, at)
            skip = n - np.diff(cut)
            head = np.maximum(0, n - -(-percent * n // 100) + 1 - skip) * (n > 0)
            # text by text, the shared ones in the global order, of which the first `head` are the prefix
            text = np.repeat(np.arange(len(n)), np.diff(cut))
            order = np.lexsort((tokens[often], level[often], text))
            nth = np.arange(len(often)) - cut[text]
            take = often[order][nth < head[text]]
            ends = np.r_[0, np.cumsum(np.minimum(head, np.diff(cut)))].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[take].view(np.int64)))
            yield pa.record_batch([b.column(0), pa.array(names, pa.binary()), pa.array(n), pa.array(skip), prefix], ["doc_id", "node", "n", "skip", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node binary, n long, skip long, prefix array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, count: int, k: int) -> DataFrame:
    """(node, tokens) of the given nodes(node, first): texts that aren't the first of a node are left out unread."""
    keep = filter_bits(nodes.select(F.xxhash64("first").alias("key")), "key", count)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            hit = keep(b.column(0).to_numpy(zero_copy_only=False))
            for texts in slices(b.column(1).filter(pa.array(hit))):
                tokens, at, names = _sets(texts, k)
                some = [(name, tokens[x:y].tobytes()) for name, x, y in zip(names, at[:-1], at[1:], strict=True) if name is not None]
                yield pa.record_batch([pa.array([x for x, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], ["node", "tokens"])

    found = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(run, "node binary, tokens binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _read(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _in_parts(pairs: DataFrame, block: int) -> DataFrame:
    """pairs(a, b, parts) with parts where it is null: so many that about `block` partners of a query are searched together.

    Only queries with more partners are named, so that no query's pairs meet in one task to be counted.
    """
    many = pairs.where("parts IS NULL").groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("more")).where("more > 1")
    return pairs.join(small(many), "a", "left").select("a", "b", F.coalesce("parts", "more", F.lit(1).cast("long")).alias("parts"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b, parts) that link, as (u, v): a is the query; its partners are dealt into `parts` searches."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    key = ["a", "parts", "part"]
    b_rows = pairs.join(sets.withColumnRenamed("node", "b"), "b").select(*key, F.col("b").alias("node"), "tokens")
    a_rows = pairs.select(*key).distinct().join(sets.withColumnRenamed("node", "a"), "a").select(*key, F.col("a").alias("node"), "tokens")

    def search(key, table):
        import pyarrow as pa

        a = key[0].as_py()
        nodes, sets_ = table.column("node").to_pylist(), _read(table.column("tokens"))
        query = next((s for v, s in zip(nodes, sets_, strict=True) if v == a), None)
        others = [i for i, v in enumerate(nodes) if v != a]
        found = []
        if query is not None and others:
            found = [nodes[others[i]] for i in divide_skip(query, [sets_[i] for i in others], percent).tolist()]
        return pa.table({"u": pa.array([a] * len(found), pa.binary()), "v": pa.array(found, pa.binary())})

    return b_rows.unionByName(a_rows).groupBy(*key).applyInArrow(search, "u binary, v binary")


def _dealt(lists: DataFrame, block: int) -> DataFrame:
    """lists with each node in all tasks (token, i, j), i <= j, where its block `own` meets blocks of its list.

    Nodes of the label that most of a list's have needn't meet each other: they have blocks of their own, after those of
    the rest, and meet the rest only. A list is dealt by so many rows as it has nodes, times the blocks of the rest.
    """
    size = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    size = size.groupBy("token").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("c"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("long")
    size = size.select("token", F.col("main.label").alias("main"), blocks(F.col("c") - F.col("main.c")).alias("rests"), blocks(F.col("main.c")).alias("mains"))
    rows = lists.join(staged(size, "jaccard-blocks"), "token").withColumn("is_main", F.col("label") == F.col("main"))
    nth = F.xxhash64("node")
    rows = rows.withColumn("own", F.when(F.col("is_main"), F.col("rests") + F.pmod(nth, F.col("mains"))).otherwise(F.pmod(nth, F.col("rests"))))
    met = F.when(F.col("is_main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "main", "rests", "mains", "is_main")


def _open_lists(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of lists(token, node, n, left, label, ...), those that hold several labels; and of these what may still link there,
    with how many nodes a list then holds, and how many (rest) that aren't of the label that most of them have.

    A meeting at the first shingle that two sets share needs left >= T on both sides. T is least with the smallest set of
    the list, so what hasn't that much left meets nobody there. What goes is still a posting that two sets have in common.
    """

    def mixed(some: DataFrame) -> DataFrame:
        sizes = some.groupBy("token", "label").agg(F.count(F.lit(1)).alias("__c"), F.min("n").alias("__n"))
        sizes = sizes.groupBy("token").agg(F.sum("__c").alias("__s"), F.max("__c").alias("__most"), F.min("__n").alias("__least")).where("__s > __most")
        return some.join(sizes.select("token", F.col("__s").alias("held"), (F.col("__s") - F.col("__most")).alias("rest"), "__least"), "token")

    able = (100 + percent) * F.col("left") >= percent * (F.col("n") + F.col("__least"))
    lists = staged(mixed(lists), "jaccard-open")
    own = [c for c in lists.columns if c not in ("held", "rest", "__least")]
    some = mixed(lists.where(able).select(*own)).where(able)
    return lists.select(*own), staged(mixed(some.select(*own)).drop("__least"), "jaccard-able")


def _overlaps(rows: np.ndarray, tokens: np.ndarray, weight: np.ndarray, left: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n nodes with postings (row, token, weight, left): the weight that two have in common, and whether they meet before.

    Before is at a token of which the first of the two has more left than `at`. Tokens come in slices, as a
    product of dense matrices.
    """
    both, before = np.zeros((n, n), np.float32), np.zeros((n, n), bool)
    names, col, count = np.unique(tokens, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count > 1)
    place = np.full(len(names), -1)
    place[some] = np.arange(len(some))
    col = place[col]
    for lo in range(0, len(some), 2048):
        k = np.flatnonzero((col >= lo) & (col < lo + 2048))
        has = np.zeros((n, min(2048, len(some) - lo)), np.float32)
        heavy, early = has.copy(), has.copy()
        has[rows[k], col[k] - lo] = 1
        heavy[rows[k], col[k] - lo] = weight[k]
        early[rows[k], col[k] - lo] = left[k] > at[rows[k]]
        both += heavy @ has.T
        before |= early @ has.T > 0
    return both, before


def _numbered(column) -> np.ndarray:
    return np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1]


def _open_pairs(table, percent: int, two_blocks: bool) -> np.ndarray:
    """Which pairs (row before row) of a task are to be searched there; see _screen_blocks."""
    n, left, own = (table.column(c).to_numpy() for c in ("n", "left", "own"))
    label = _numbered(table.column("label"))
    lists = table.column("open").combine_chunks()
    posts = lists.flatten()
    token, weight, has = (posts.field(c).to_numpy(zero_copy_only=False) for c in ("token", "mult", "left"))
    both, before = _overlaps(np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy()), token, weight, has, left, len(n))
    t_of = need(n[:, None], n[None, :], percent)
    t0 = -(-percent * np.maximum(n[:, None], n[None, :]) // 100)
    ok = (label[:, None] != label[None, :]) & ~before & (np.minimum(left[:, None], left[None, :]) >= t_of) & (both >= t_of - t0 + 1)
    if two_blocks:
        ok &= own[:, None] != own[None, :]
    return np.triu(ok, 1)


#: The columns of a task's rows, and how many pairs for each of its nodes it may name.
_IN_TASK = ("token", "i", "j", "own", "node", "n", "left", "label", "open")
_PER_NODE = 8


def _screen_blocks(lists: DataFrame, able: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """What is left to search of lists(token, node, n, left, label, mult): pairs(a, b), and the rows of crowded tasks, if any.

    able has those rows of lists whose node may link there (see _open_lists): they are dealt; the others still count as shared.

    Two nodes of different labels count in the task of the first list in which they meet, if both have enough
    left there, and if their prefixes share enough: beyond its prefix a set has T0 - 1 shingles, T0 = ceil(percent
    * n / 100), so that a pair which needs T shares T - T0 + 1 within the prefixes, for the larger of its two T0.
    A task that holds more such pairs than a few a node names itself, for its sets to be searched, and no pair.
    """
    own = lists.groupBy("node").agg(F.collect_list(F.struct("token", "left", "mult")).alias("open"))
    rows = _dealt(able, block).join(staged(own, "jaccard-own"), "node").select(*_IN_TASK)

    def screen(key, table):
        import pyarrow as pa

        a, b = np.nonzero(_open_pairs(table, percent, key[1] != key[2]))
        nodes = table.column("node")
        if len(a) > _PER_NODE * table.num_rows:
            return pa.table({"a": pa.array([None], pa.binary()), "b": pa.array([None], pa.binary()), "token": pa.array([key[0].as_py()]), "i": pa.array([key[1].as_py()]), "j": pa.array([key[2].as_py()])})
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b)), **{c: pa.array(np.full(len(a), k.as_py())) for c, k in zip(("token", "i", "j"), key, strict=True)}})

    found = staged(rows.groupBy("token", "i", "j").applyInArrow(screen, "a binary, b binary, token long, i long, j long"), "jaccard-screened")
    crowded = found.where("a IS NULL").select("token", "i", "j")
    return found.where("a IS NOT NULL").select("a", "b"), rows.join(crowded, ["token", "i", "j"], "left_semi") if crowded.take(1) else None


def _search_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect all nodes of the given tasks which link directly.

    Each task searches one node after the other among those that it may link with and isn't connected to
    yet, and yields fewer links than it has nodes; rows grow with a list's length times its blocks, never
    with its pairs.
    """

    def search(key, table):
        import pyarrow as pa

        nodes, sets_ = table.column("node").to_pylist(), _read(table.column("tokens"))
        ok, label = _open_pairs(table, percent, key[1] != key[2]).T, _numbered(table.column("label"))
        u, v = [], []
        for q in range(len(nodes)):
            others = np.flatnonzero(ok[q] & (label != label[q]))
            if len(others):
                for i in others[divide_skip(sets_[q], [sets_[i] for i in others], percent)].tolist():
                    if label[i] != label[q]:
                        u.append(nodes[q])
                        v.append(nodes[i])
                        label[label == label[i]] = label[q]
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return rows.join(sets, "node").select(*_IN_TASK, "tokens").groupBy("token", "i", "j").applyInArrow(search, "u binary, v binary")


def _labels(links: DataFrame, steps: int = 2) -> DataFrame:
    """(node, label): label is a node of the same component, mostly its least one.

    Two nodes with one label are connected; nodes of one component may still have two, which costs searches
    but no link. Each step takes the label of the label.
    """
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = staged(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "jaccard-labels")
    for _ in range(steps):
        far = found.select(F.col("node").alias("label"), F.col("label").alias("far"))
        found = found.join(far, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"))
    return found


def _links(lists: DataFrame, sets: DataFrame, percent: int, star_rounds: int, short: int, block: int) -> DataFrame:
    """Verified links (u, v) that connect all that links.

    lists(token, node, n, skip, left, c, mult): left counts the node's shingles from this one on in the global
    order, c the nodes of the list, mult the tokens that have this list. At the first shingle that two sets share, both have at least T left, with T the
    overlap that they need; so a meeting at which either has fewer is left out, which rules out most pairs
    of a group whose texts differ too much.
    """

    def able(x: str, y: str) -> Column:
        return (100 + percent) * F.least(f"{x}.left", f"{y}.left") >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def crossed(some: DataFrame) -> DataFrame:
        """All pairs of the given lists whose labels differ."""
        two = some.alias("x").join(some.alias("y"), F.col("x.token") == F.col("y.token"))
        two = two.where((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & able("x", "y"))
        return two.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(None).cast("long").alias("parts")).distinct()

    def met(some: DataFrame, star: DataFrame) -> DataFrame:
        return some.alias("x").join(star.alias("y"), F.col("token") == F.col("__token")).where((F.col("x.node") != F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & able("x", "y"))

    def starred(some: DataFrame, turn: int) -> DataFrame:
        """For each node one partner: the best of the stars of its lists, a list's star being its best node.

        Better is, at first, what has the fewest shingles of its own (a group's centre has few), then what
        comes first by a hash, so that the nodes of a group choose alike. Later turns go by other hashes.
        """
        own = F.col("skip") / F.col("n") if turn == 0 else F.lit(0.0)
        star = some.groupBy("token").agg(F.min(F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "left", "label")).alias("s"))
        star = staged(star, "jaccard-stars").select(F.col("token").alias("__token"), "s.*")
        best = met(some, star).groupBy("x.node").agg(F.min(F.struct("y.own", "y.h", F.col("y.node").alias("a"), F.ceil(F.col("c") / F.lit(block)).cast("long").alias("parts"))).alias("s"))
        return best.select("s.a", F.col("node").alias("b"), "s.parts")

    def starred_again(some: DataFrame, turn: int) -> DataFrame:
        """For each node up to STARS partners: the stars of its longest list, which are nodes drawn by hash, so that some are of its group's middle."""
        h = F.xxhash64("node", F.lit(turn))
        star = some.groupBy("token", F.pmod(h, F.lit(STARS)).alias("nth")).agg(F.min(F.struct(h.alias("h"), "node", "n", "left", "label")).alias("s"))
        star = staged(star, "jaccard-stars").select(F.col("token").alias("__token"), "s.*")
        first = some.groupBy("node").agg(F.max(F.struct("held", "token")).alias("s")).select(F.col("node").alias("__node"), F.col("s.token").alias("__first"))
        some = some.join(first, (F.col("node") == F.col("__node")) & (F.col("token") == F.col("__first")), "left_semi")
        return met(some, star).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.ceil(F.col("held") / F.lit(block)).cast("long").alias("parts"))

    def searched(pairs: DataFrame) -> DataFrame:
        return staged(_verify(_in_parts(staged(pairs, "jaccard-pairs"), block), sets, percent), "jaccard-links")

    lists = lists.withColumn("label", F.col("node"))
    pairs = crossed(lists.where(F.col("c") <= short))
    lists = lists.where(F.col("c") > short)
    links, some, turn, was = None, None, 0, None
    while True:
        if turn < star_rounds:
            more = starred(lists, turn)
        elif star_rounds:
            # of lists of more than a block, each turn leaves a part of the rows outside the largest labels, or is the last
            long_ = some.where(F.col("held") > block)
            now = long_.agg(F.sum(F.col("rest") / F.col("held"))).first()[0] or 0.0
            if not now or (was is not None and 100 * now > LEFT * was):
                break
            more, was = starred_again(long_, turn), now
        else:
            break
        new = searched(more if pairs is None else pairs.unionByName(more))
        links, pairs, turn = new if links is None else links.unionByName(new), None, turn + 1
        labels = staged(_labels(links), "jaccard-found")
        lists = lists.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lists, some = _open_lists(lists, percent)
        if not some.take(1):
            return links
    if not star_rounds:
        lists, some = _open_lists(lists, percent)
    more, crowded = _screen_blocks(lists, some, percent, block)
    if crowded is not None:
        new = staged(_search_blocks(crowded, sets, percent), "jaccard-links")
        links = new if links is None else links.unionByName(new)
    more = more.withColumn("parts", F.lit(None).cast("long"))
    new = searched(more if pairs is None else pairs.unionByName(more))
    return new if links is None else links.unionByName(new)


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, star_rounds: int = 2, short: int = SHORT, block: int = GROUP) -> DataFrame:
    """Connected components of documents whose sets of k-word shingles have Jaccard similarity >= percent / 100.

    docs needs doc_id and text; other columns are ignored. Words are runs of anything but space and \\t to
    \\r, A-Z lower-cased; a text of fewer than k words is one shingle; a null or empty text has no set and
    links with nothing. Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    of its component; its own if alone). Repeated rows and equal texts are one class; rows of one doc_id
    with other texts are judged by their texts. An empty table gives none.

    1. Equal sets are one node, named by 128 bits. Shingles are ordered by class (found in one document only
       first, then by how often they occur), then by hash; a node posts the shared ones in its prefix of
       n - T + 1. What links meets at a posting, and frequent passages come last, so their lists stay out of
       most prefixes. Of lists with the same nodes only the first in that order stays.
    2. All pairs of a short list are searched. Of the long lists each node is searched against one star, in
       star_rounds turns, and of lists of more than a block in further turns while they get fewer: it makes one
       pair a node and turn, and one link at most. What links has one label.
    3. Lists that still hold several labels are dealt into blocks, and each two blocks meet in a task, but for two
       of the label that most have, and without what can't link there for want of shingles left: it
       names the pairs whose prefixes allow a link, or, where those are many, is searched whole. Nothing is
       capped: a pair is left out only if it can't reach the similarity, or if both are connected.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = staged(_prefixes(docs, k, percent), "jaccard-nodes")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("skip").alias("skip"), F.first("prefix").alias("prefix"))
    nodes = staged(nodes, "jaccard-sets-named")
    posts = nodes.where(F.size("prefix") > 0).select(F.posexplode("prefix").alias("at", "token"), "node", "n", "skip", "first")
    posts = posts.select("token", "node", "n", "skip", "first", (F.col("n") - F.col("skip") - F.col("at")).alias("left"))
    # a meeting needs left >= T of itself with the smallest partner there can be
    posts = posts.where(F.col("left") * 100 >= F.col("n") * percent)
    name = F.xxhash64("node")
    listed = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum(name.cast("decimal(38,0)")).alias("f"), F.sum(F.xxhash64(name, F.lit(1)).cast("decimal(38,0)")).alias("g"), F.sum("left").alias("left")).where("c > 1")
    # lists of the same nodes: the first of them in the global order, at which each has most left, stands for all
    listed = staged(listed.groupBy("c", "f", "g").agg(F.max_by("token", "left").alias("token"), F.count(F.lit(1)).alias("mult")).select("token", "c", "mult"), "jaccard-listed")
    lists = staged(posts.join(listed, "token"), "jaccard-lists")
    searched = staged(lists.select("node", "first").distinct(), "jaccard-searched")
    n_searched = searched.count()
    named = nodes.select("node", "first")
    if n_searched:
        sets = staged(_sets_of(docs, searched, n_searched, k), "jaccard-sets")
        labels = components(_links(lists.drop("first"), sets, percent, star_rounds, short, block))
        named = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("first").alias("component"))
        named = named.join(least, "comp").select("node", "component")
    else:
        named = named.withColumnRenamed("first", "component")
    named = staged(named, "jaccard-names").withColumnRenamed("node", "__node")
    out = rows.join(named, F.col("node") == F.col("__node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of their class, one row each, with the columns of docs.

    A class is as in jaccard_classes, and rows are told apart by doc_id and text: a row goes only if its own
    text's class has a smaller member, or if it repeats a row's doc_id and text. So an id with texts of two
    classes can stay with one of them, or with both; documents without shingles stay each. Rows with a null
    doc_id have no name to be dropped by, and stay. Columns of any names return unchanged; an empty table
    gives none. Rows that surely stay are not shuffled.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    named = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", key.alias("key"))).alias("doc_id"), "text")
    classes = staged(jaccard_classes(named, k, percent), "jaccard-classes").where("doc_id IS NOT NULL")
    name_id, name_key, name_nth = (unused(c, docs) for c in ("__id", "__text_key", "__nth"))
    gone = classes.groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("late"), F.count(F.lit(1)).alias("rows"))
    gone = gone.where("late = 1 OR rows > 1").select(F.col("doc_id.doc_id").alias(name_id), F.col("doc_id.key").alias(name_key), "late")
    gone = staged(gone, "jaccard-gone")
    rest, some = parted(docs, [F.col("doc_id"), key], gone.select(name_id, name_key))
    late = gone.where("late = 1")
    some = some.join(late, (F.col("doc_id") == F.col(name_id)) & (key == F.col(name_key)), "left_anti")
    # whatever may repeat comes once; rows without an id are all kept
    nth = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("text"))
    some = some.withColumn(name_nth, F.when(F.col("doc_id").isNotNull(), nth).otherwise(1)).where(F.col(name_nth) == 1)
    return rest.unionByName(some.drop(name_nth)).select(*[F.col(f"`{c}`") for c in docs.columns])
