"""Property-graph projection, neighbourhoods, stages and clusters of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.sinks import checkpointed


def edges(facts: DataFrame, nodes: DataFrame, on: str = "book", name: str = "name", node: str = "node_id") -> DataFrame:
    """Facts (source, target) between nodes; a fact with an unknown end makes no edge."""
    s = nodes.select(on, F.col(name).alias("source"), F.col(node).alias("source_id"))
    t = nodes.select(on, F.col(name).alias("target"), F.col(node).alias("target_id"))
    return facts.join(s, [on, "source"]).join(t, [on, "target"])


def participation(events: DataFrame, nodes: DataFrame, on: str = "book", name: str = "name", node: str = "node_id") -> DataFrame:
    p = events.select(on, "event_id", F.explode("participants").alias(name))
    return p.join(nodes.select(on, name, node), [on, name]).select(on, "event_id", node).distinct()


def neighbours(edges_: DataFrame, starts: DataFrame, on: str = "book") -> DataFrame:
    """One hop along relations, within the book."""
    return edges_.join(starts.select(on, F.col("name").alias("source")).distinct(), [on, "source"]).select(on, "source", "type", "target")


def plot_stages(books: DataFrame, n: str = "chapters") -> DataFrame:
    """Stages of books: one up to three chapters, else thirds, the last with the rest."""
    third = F.greatest(F.lit(1), F.floor(F.col(n) / 3)).cast("int")
    s = lambda i, name, a, b: F.struct(F.lit(i).alias("stage_index"), F.lit(name).alias("stage_name"), a.cast("int").alias("start_chapter"), b.cast("int").alias("end_chapter"))
    few = F.array(s(1, "全书", F.lit(1), F.col(n)))
    many = F.array(s(1, "开端", F.lit(1), third), s(2, "发展", third + 1, third * 2), s(3, "结局", third * 2 + 1, F.col(n)))
    return books.withColumn("_s", F.explode(F.when(F.col(n) <= 3, few).otherwise(many))).select(*books.columns, "_s.*")


def canonical_names(facts: DataFrame, aliases: DataFrame, on: str = "book", skip: tuple = ("", "未知", "无")) -> DataFrame:
    """Ends of facts by the alias map (book, alias, name); those in skip stay."""
    m = aliases.where(~F.col("alias").isin(*skip)).groupBy(on, "alias").agg(F.min("name").alias("name"))
    s = m.select(on, F.col("alias").alias("source"), F.col("name").alias("_s"))
    t = m.select(on, F.col("alias").alias("target"), F.col("name").alias("_t"))
    j = facts.join(s, [on, "source"], "left").join(t, [on, "target"], "left")
    return j.withColumn("source", F.coalesce("_s", "source")).withColumn("target", F.coalesce("_t", "target")).drop("_s", "_t")


#: Pairs of a component up to which one task takes it; larger ones are decided in rounds.
SERIAL = 200_000


def direct_clusters(pairs: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Greedy profiles, exactly: in order of names, one not yet taken takes its direct neighbours that are free.

    A name is a head if none of its smaller neighbours is one, else it goes to the smallest of these.  Pairs
    (name_a, name_b) are MERGE decisions of one group.  Whole components of at most SERIAL pairs are worked off one by
    one, so a long chain of names takes one pass; in larger ones all names whose smaller neighbours have decided decide
    at once, round by round, by joins: a hub decides its neighbours in two rounds, however many.
    """
    two = pairs.where("name_a <> name_b").select(on, F.least("name_a", "name_b").alias("lo"), F.greatest("name_a", "name_b").alias("hi")).distinct()
    two = checkpointed(two)
    every = names.select(on, "name").distinct()
    part = clusters(two.select(on, F.col("lo").alias("name_a"), F.col("hi").alias("name_b")), two.select(on, F.col("lo").alias("name")).unionByName(two.select(on, F.col("hi").alias("name"))), on)
    marked = checkpointed(two.join(part.select(on, F.col("name").alias("lo"), F.col("canonical").alias("_c")), [on, "lo"]))
    sizes = marked.groupBy(on, "_c").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > SERIAL).select(on, "_c")
    kind = names.schema[on].dataType.simpleString()

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list[str]] = {}
        for lo, hi in zip(p["lo"], p["hi"], strict=True):
            below.setdefault(hi, []).append(lo)
        head: dict[str, str] = {}
        for name in sorted(set(p["lo"]) | set(p["hi"])):
            head[name] = min((x for x in below.get(name, ()) if head[x] == x), default=name)
        return pd.DataFrame({on: [key[0]] * len(head), "name": list(head), "canonical": list(head.values())})

    small = marked.join(large, [on, "_c"], "left_anti").groupBy(on, "_c").applyInPandas(run, f"{on} {kind}, name string, canonical string")
    decided = small
    rest = checkpointed(marked.join(large, [on, "_c"], "left_semi").select(on, "lo", "hi"))
    if not rest.isEmpty():
        decided = decided.unionByName(_in_rounds(rest, on))
    return every.join(decided, [on, "name"], "left").select(on, "name", F.coalesce("canonical", "name").alias("canonical"))


def _in_rounds(edges_: DataFrame, on: str) -> DataFrame:
    """direct_clusters of names with edges (lo, hi): heads are the lexicographically first independent set."""
    names = edges_.select(on, F.col("lo").alias("name")).unionByName(edges_.select(on, F.col("hi").alias("name"))).distinct()
    heads = edges_.sparkSession.createDataFrame([], names.schema)
    open_, left = checkpointed(names), edges_
    while not open_.isEmpty():
        waits = left.select(on, F.col("hi").alias("name")).distinct()
        new = checkpointed(open_.join(waits, [on, "name"], "left_anti"))  # no smaller neighbour is still open
        heads = heads.unionByName(new)
        taken = left.join(new.select(on, F.col("name").alias("lo")), [on, "lo"], "left_semi").select(on, F.col("hi").alias("name")).distinct()
        gone = new.unionByName(taken)
        open_ = checkpointed(open_.join(gone, [on, "name"], "left_anti"))
        still = lambda c: open_.select(on, F.col("name").alias(c))  # noqa: E731, B023
        left = checkpointed(left.join(still("lo"), [on, "lo"], "left_semi").join(still("hi"), [on, "hi"], "left_semi"))
    heads = checkpointed(heads)
    own = edges_.join(heads.select(on, F.col("name").alias("lo")), [on, "lo"], "left_semi").groupBy(on, F.col("hi").alias("name")).agg(F.min("lo").alias("canonical"))
    return names.join(own, [on, "name"], "left").select(on, "name", F.coalesce("canonical", "name").alias("canonical"))


def clusters(pairs: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Transitive profiles: smallest name reachable by MERGE pairs.

    Each name hooks onto its smallest smaller neighbour and pointers jump until all point at roots; pairs are renamed to
    the roots and the round repeats while any are left.  Jumps double, so a chain of n names takes about log n of them.
    """
    every = names.select(on, "name").distinct()
    edge = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("e")
    left = checkpointed(pairs.where("name_a <> name_b").select(on, edge("name_a", "name_b")).distinct().select(on, "e.a", "e.b"))
    out = every.withColumn("canonical", F.col("name"))
    while not left.isEmpty():
        low = left.groupBy(on, F.col("b").alias("name")).agg(F.min("a").alias("root"))
        roots = left.select(on, F.col("a").alias("name")).distinct().join(low, [on, "name"], "left_anti").withColumn("root", F.col("name"))
        f = checkpointed(low.unionByName(roots))
        while True:
            up = f.select(on, F.col("name").alias("root"), F.col("root").alias("_up"))
            f = checkpointed(f.join(up, [on, "root"]).select(on, "name", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")))
            moved = not f.where("moved").isEmpty()
            f = f.drop("moved")
            if not moved:
                break
        end = lambda c, r: f.select(on, F.col("name").alias(c), F.col("root").alias(r))  # noqa: E731, B023
        out = out.join(end("canonical", "_root"), [on, "canonical"], "left").select(on, "name", F.coalesce("_root", "canonical").alias("canonical"))
        left = checkpointed(left.join(end("a", "_a"), [on, "a"]).join(end("b", "_b"), [on, "b"]).where("_a <> _b").select(on, edge("_a", "_b")).distinct().select(on, "e.a", "e.b"))
    return out


def last_transitions(df: DataFrame, keys: list[str], order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Transitions of state machines that are not in the table."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = df.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    pair = F.concat_ws(">", "before", state)
    return t.where(~pair.isin(*[f"{a}>{b}" for a, b in legal]))
