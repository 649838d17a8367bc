"""Connected components by alternating star contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Takes and gives edges with a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    across = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return across.union(low.select("a", F.col("low").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; a component is named by its smallest node.

    Edges with a null end and loops are left out, repeated edges count once, an empty list gives an empty
    table. Each round halves path lengths at least, is written to the shared folder (no growing lineage) and
    ends when no edge changes. Node groups are only ever reduced with min(), which combines before the
    shuffle; the joins on a hub's key are plain joins that adaptive execution may split.
    """
    now = materialise(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct()
    )
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if seen == mark or not seen["n"]:
            break
        mark = seen
        now = materialise(_small_star(_large_star(now).distinct()).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def resolved(links: DataFrame, entity: str, url: str, owns: Column) -> DataFrame:
    """(entity, head): who is one with whom, named by the smallest id; every entity of ``links`` is there.

    ``links`` says which addresses an entity has: its own ones (``owns``) and those it attests. An address that
    someone owns joins all that have it; one that is only attested, such as a page many link to, joins no one.
    Addresses are no nodes: each joins its entities to the smallest of them, so ids may have any value.
    """
    rows = links.select(F.col(entity).alias("e"), F.col(url).alias("u"), F.coalesce(owns, F.lit(False)).alias("o")).where("e is not null and u is not null")
    low = rows.groupBy("u").agg(F.min("e").alias("low"), F.bool_or("o").alias("owned")).where("owned")
    parts = connected_components(rows.join(low, "u").select(F.col("e").alias("a"), F.col("low").alias("b")))
    every = links.select(F.col(entity).alias("entity")).where("entity is not null").distinct()
    return every.join(parts, F.col("entity") == F.col("node"), "left").select("entity", F.coalesce("component", "entity").alias("head"))


def added_sources(heads: DataFrame, claims: DataFrame, entity: str, key: str, at: str) -> DataFrame:
    """(entity, head): sources that curators added join them, on top of the clusters that ``heads`` (entity, head) gives.

    ``claims`` says which curator (an entity, ``key``) claims an entity and when (``at``). A claim is one of the curator's
    cluster on the entity's whole cluster. A cluster joins the one whose claim is earliest, unless it is among its own
    claimants: then it stays theirs, and no claim makes two curators one. Claims of or on unknown entities count for
    nothing. All joins are decided on the clusters as they were, and made together.
    """
    of = lambda c, name: heads.select(F.col("entity").alias(c), F.col("head").alias(name))
    rows = claims.select(F.col(entity).alias("_e"), F.col(key).alias("_k"), F.col(at).alias("_at")).join(of("_e", "a"), "_e").join(of("_k", "b"), "_k")
    by = rows.groupBy("a").agg(F.min(F.struct("_at", "b")).alias("_first"), F.bool_or(F.col("a") == F.col("b")).alias("_own"))
    parts = connected_components(by.where("not _own").select("a", F.col("_first.b").alias("b")))
    return heads.join(parts, F.col("head") == F.col("node"), "left").select("entity", F.coalesce("component", "head").alias("head"))


def ancestries(posts: DataFrame, node: str, parent: str, link: Column | None = None, rounds: int = 40) -> DataFrame:
    """(node, root, depth, unbroken) of every post: the post at the top of its replies, how far above it is, and whether ``link`` holds all the way.

    Pointers are doubled: in each round a post that isn't done takes over what the post it points at points at, so a
    chain of n posts takes about log2(n) rounds, and is done with a post that is. ``link`` is an expression over
    a reply's own columns and, with ``up_`` before their names, those of the post it answers (for instance the same
    author). A parent that isn't there ends a chain: the reply to it is a top. Posts in a ring have null. Nodes are
    unique and not null.
    """
    up = posts.select(*(F.col(c).alias(f"up_{c}") for c in posts.columns))
    holds = F.coalesce(link, F.lit(False)) if link is not None else F.lit(True)
    tied = posts.join(up, F.col(parent) == F.col(f"up_{node}"), "left")
    top = F.col(f"up_{node}").isNull()
    first = tied.select(F.col(node).alias("node"), F.coalesce(f"up_{node}", node).alias("at"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), (top | holds).alias("unbroken"), top.alias("done"))
    now = materialise(first)
    done, going = [now.where("done")], now.where("not done")
    for _ in range(rounds):
        if going.isEmpty():
            break
        over = reduce(DataFrame.union, [going, *done])
        y = over.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("unbroken").alias("_unbroken"), F.col("done").alias("_done"))
        now = materialise(going.join(y, "at").select("node", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("unbroken") & F.col("_unbroken")).alias("unbroken"), F.col("_done").alias("done")))
        done.append(now.where("done"))
        going = now.where("not done")
    ring = going.select("node", F.lit(None).cast(dict(going.dtypes)["at"]).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(False).alias("unbroken"))
    return reduce(DataFrame.union, done).select("node", F.col("at").alias("root"), "depth", "unbroken").union(ring)


def self_threads(posts: DataFrame, node: str, parent: str, author: str, order: str, text: str) -> DataFrame:
    """(root, author, posts, body_sha256): the posts that an author wrote on to an own post, without those to others, in order.

    A post by someone else cuts what hangs below it. Texts are put together with empty lines between them.
    """
    own = ancestries(posts.select(node, parent, author), node, parent, F.col(author) == F.col(f"up_{author}")).where("unbroken").select(F.col("node").alias(node), "root")
    rows = posts.join(own, node).select("root", author, F.struct(order, F.col(node).alias("_node"), F.col(text).alias("_text")).alias("_p"))
    whole = rows.groupBy("root", author).agg(F.array_sort(F.collect_list("_p")).alias("_all"))  # one author's own posts in one thread
    return whole.select("root", author, F.size("_all").cast("long").alias("posts"), F.sha2(F.array_join(F.transform("_all", lambda p: F.coalesce(p["_text"], F.lit(""))), "\n\n"), 256).alias("body_sha256"))
