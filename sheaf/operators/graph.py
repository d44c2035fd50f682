"""Merging, searching and describing entity graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.operators.components import connected_components
from sheaf.session import cut, discard, long_rows_ready, written

SEP = "§"


def merge_alias(nodes: DataFrame) -> DataFrame:
    """(name, alias): aliases of a name united."""
    return nodes.select("name", F.explode_outer("alias").alias("a")).groupBy("name").agg(F.array_sort(F.collect_set("a")).alias("alias"))


def merge_directed(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """(src, rel, tgt, confidence: the largest, file_info: the last writer's)."""
    return edges.groupBy("src", "rel", "tgt").agg(F.max("confidence").alias("confidence"), F.max_by("file_info", seq).alias("file_info"))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes by name: the most frequent type (the smallest where even), descriptions and files sorted and distinct, chunks counted."""
    types = mentions.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"))
    kind = types.groupBy("entity_name").agg(F.min_by("entity_type", F.struct(-F.col("n"), "entity_type")).alias("entity_type"))
    g = mentions.groupBy("entity_name").agg(
        F.array_join(F.array_sort(F.collect_set("description")), SEP).alias("description"), F.count_distinct("chunk_id").alias("mention_count"), F.array_join(F.array_sort(F.collect_set("file_path")), SEP).alias("file_paths"))
    return g.join(kind, "entity_name")


def merge_edges(relations: DataFrame) -> DataFrame:
    """Edges by unordered pair: weights summed, descriptions and keywords sorted and distinct."""
    x = relations.select(F.least("src_id", "tgt_id").alias("src_id"), F.greatest("src_id", "tgt_id").alias("tgt_id"), "weight", "description", F.split("keywords", r"\s*,\s*").alias("k"))
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set("k"))))
    return x.groupBy("src_id", "tgt_id").agg(F.round(F.sum("weight"), 6).alias("weight"), F.array_join(F.array_sort(F.collect_set("description")), SEP).alias("description"), F.array_join(words, ",").alias("keywords"))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, as `Unknown` ones with count 0."""
    ends = edges.select(F.col("src_id").alias("entity_name")).union(edges.select("tgt_id")).distinct()
    return ends.join(nodes.select("entity_name"), "entity_name", "left_anti").select("entity_name", F.lit("Unknown").alias("entity_type"), F.lit(0).alias("mention_count"))


def neighbours(edges: DataFrame, starts: DataFrame, hops: int, a: str = "src", b: str = "tgt") -> DataFrame:
    """(start, node, hop): nodes within so many hops of each start, without it, at their smallest number of hops."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct()
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for k in range(1, hops + 1):
        step = front.join(both, front.node == both.u).select("start", F.col("v").alias("node")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.union(front)
    return seen.where("hop > 0")


def induced(edges: DataFrame, names: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """Edges both of whose ends are among names(node)."""
    n = names.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", a), a, "left_semi").join(n.withColumnRenamed("node", b), b, "left_semi")


def stats(edges: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """Nodes, edges, components, mean degree."""
    e = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    comp = connected_components(edges, a, b)
    c = comp.agg(F.count_distinct("node").alias("nodes"), F.count_distinct("component").alias("components"))
    return c.crossJoin(e.agg(F.count("*").alias("edges"))).select("nodes", "edges", "components", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"))


def lookup(edges: DataFrame, terms: DataFrame, aliases: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(term, text, confidence, rank): edges with an end that is the term by its name or an alias, best k by confidence, as `src - rel -> tgt`.

    edges: (src, rel, tgt, confidence); terms: (term); aliases: (name, alias: array). Each end is joined on its own, and an edge counts once for a term.
    """
    t = terms.select("term").distinct()
    called = t.select(F.col("term").alias("name"), "term")
    if aliases is not None:
        called = called.union(aliases.select("name", F.explode("alias").alias("term")).join(t, "term").select("name", "term")).distinct()
    at = lambda end: edges.join(called, F.col(end) == F.col("name")).drop("name")
    x = at("src").unionByName(at("tgt")).select("term", "src", "rel", "tgt", "confidence").distinct()
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(F.desc("confidence"), "src", "rel", "tgt"))).where(F.col("rank") <= k)
    return x.select("term", F.concat("src", F.lit(" - "), "rel", F.lit(" -> "), "tgt").alias("text"), "confidence", "rank")


def second_pass(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Mentions of the first pass, and those of the second that are new."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


#: Tables of found paths after which they are written as one.
GATHERED = 8


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int | None = None, a: str = "src", b: str = "tgt") -> DataFrame:
    """(start, end, path): a shortest path between the ends of each pair, the smallest names where even; null where there is none, or none of `most` steps or fewer if that is given.

    The search goes out from the starts and from the ends, from each once however many pairs it is in, and in each round from the side that has fewer edges before it. Neighbours of the nodes
    of one distance are one nearer, as far or one farther: so only the last two distances are kept, with the smallest path to each node. Pairs are joined where the two sides meet, and
    given up once one of their ends has nowhere else to go.
    """
    pair = ["start", "end"]
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u is not null and v is not null and u <> v").distinct())
    degree = written(both.groupBy("u").agg(F.count("*").alias("d")))
    p = pairs.select(*pair).distinct()
    found = [written(p.where("start = end").select(*pair, F.array("start").alias("path")))]
    open_ = written(p.where("start <> end"))
    roots = lambda side: open_.select(F.col(side).alias("root")).distinct()
    fronts = {side: written(roots(side).select("root", F.col("root").alias("node"), F.array("root").alias("path"))) for side in pair}
    before = {side: None for side in pair}
    ahead = lambda side: fronts[side].join(degree, F.col("node") == F.col("u")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n")).first()["n"]
    work = {side: ahead(side) for side in pair}
    far = 0
    while not open_.isEmpty() and (most is None or far < most):
        far += 1
        side = min(pair, key=lambda x: work[x])
        front, last = fronts[side], before[side]
        step = front.join(roots(side), "root", "left_semi").join(both, F.col("node") == F.col("u"))
        # From the start a path grows behind, from the end before.
        step = step.select("root", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path") if side == "start" else F.concat(F.array("v"), "path").alias("path"))
        seen = front.select("root", "node") if last is None else front.select("root", "node").unionByName(last.select("root", "node"))
        new = written(step.groupBy("root", "node").agg(F.min("path").alias("path")).join(seen, ["root", "node"], "left_anti"))
        if last is not None:
            discard(last)
        fronts[side], before[side], work[side] = new, front, None
        work[side] = ahead(side)
        s, e = (fronts[x].select(F.col("root").alias(x), "node", F.col("path").alias(f"_{x}")) for x in pair)
        # Where many pairs share their ends the sides meet first, else each pair takes its start's nodes along.
        meeting = s.groupBy("node").agg(F.count("*").alias("x")).join(e.groupBy("node").agg(F.count("*").alias("y")), "node").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n")).first()["n"]
        if meeting:
            taken = s.groupBy("start").agg(F.count("*").alias("x")).join(open_, "start").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n")).first()["n"]
            met = s.join(e, "node").join(open_, pair, "left_semi") if meeting <= taken else open_.join(s, "start").join(e, ["end", "node"])
            met = written(met.groupBy(*pair).agg(F.min(F.concat("_start", F.slice("_end", F.lit(2), F.size("_end")))).alias("path")))
            found.append(met)
            if len(found) > GATHERED:
                one = written(reduce(DataFrame.unionByName, found))
                discard(*found)
                found = [one]
            left = open_.join(met.select(*pair), pair, "left_anti")
        else:
            left = open_
        left = written(left.join(new.select(F.col("root").alias(side)).distinct(), side, "left_semi"))
        discard(open_)
        open_ = left
    paths = reduce(DataFrame.unionByName, found)
    return p.join(paths, p["start"].eqNullSafe(paths["start"]) & p["end"].eqNullSafe(paths["end"]), "left").select(p["start"], p["end"], "path")


def keywords(question: Column, stopwords: list[str]) -> Column:
    """Words of a question without stop words and single characters, marks stripped."""
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: ~w.isin(stopwords) & (F.length(w) > 1))
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", ""))


def node_text() -> Column:
    """`name (type): descriptions` of merged nodes."""
    return F.concat("entity_name", F.lit(" ("), "entity_type", F.lit("): "), F.replace("description", F.lit(SEP), F.lit(", ")))


def relations(answers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, src, rel, tgt, confidence) from a table of an extractor's answers (key, type, content, metadata, answer) (G1).

    Chunks of text and tables are read by their content, others by their metadata: blank ones give nothing. Relations without a description are skipped.
    """
    text = F.when(F.col("type").isin("text", "table"), F.col("content")).otherwise(F.col("metadata"))
    each = answers.where(F.trim(text) != "").select(key, F.explode(F.from_json("answer", "array<struct<source_node:struct<name:string>,target_node:struct<name:string>,relationship_description:string,confidence:string>>")).alias("r"))
    x = each.select(key, F.col("r.source_node.name").alias("src"), F.col("r.relationship_description").alias("rel"), F.col("r.target_node.name").alias("tgt"), F.col("r.confidence").try_cast("double").alias("confidence"))
    return x.where(F.trim("rel") != "")


#: Characters of the pieces by which texts that hold each other meet.
GRAM = 4


def holding(whole: DataFrame, part: DataFrame) -> DataFrame:
    """(k, p) of rows of whole (k, text) whose text holds that of a row of part (p, text), case ignored.

    A text that holds another holds all of its pieces of GRAM characters: each part waits under the one of its pieces that fewest parts have, or whole if it is shorter, and texts come
    by with all of theirs. So they meet by equality, and the texts themselves decide.
    """
    w = whole.select("k", F.lower("text").alias("text")).where("text is not null")
    q = written(part.select("p", F.lower("text").alias("said")).where("said is not null").distinct())
    grams = lambda t, n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = q.where(F.length("said") >= GRAM).select("p", "said", F.explode(F.array_distinct(grams(F.col("said"), GRAM))).alias("g"))
    often = pieces.groupBy("g").agg(F.count("*").alias("n"))
    rarest = pieces.join(often, "g").groupBy("p", "said").agg(F.min(F.struct("n", "g")).alias("r")).select("p", "said", F.col("r.g").alias("g"))
    keyed = rarest.unionByName(q.where(F.length("said") < GRAM).select("p", "said", F.col("said").alias("g")))
    short = [r.n for r in q.where(F.length("said") < GRAM).select(F.length("said").alias("n")).distinct().collect()]  # GRAM of them at most
    sizes = [grams(F.col("text"), n) if n else F.array(F.lit("")) for n in {GRAM, *short}]
    met = w.select("k", "text", F.explode(F.array_distinct(F.concat(*sizes))).alias("g")).join(keyed, "g")
    return met.where(F.contains("text", "said")).select("k", "p").distinct()


def match_entities(queries: DataFrame, terms: DataFrame, nodes: DataFrame, close: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, entity_name, score, rank): nodes a question names, best k by score and mentions.

    queries: (q_id, query), terms: (q_id, term) that were extracted from these, nodes: (entity_name, mention_count), close: (q_id, entity_name, cosine).
    A name in the question, or the question in a name, scores 1; a term in a name, or a name in a term, 0.8. Only questions without either
    take the nodes of a cosine over 0.5 among the 2k closest. Case is ignored. Names and questions meet by pieces of theirs (`holding`).
    """
    names = nodes.select(F.col("entity_name").alias("name"), F.col("entity_name").alias("text"))

    def either(said, text, score):
        own = said.select("q_id", F.col(text).alias("text"))
        inside = holding(own.withColumnRenamed("q_id", "k"), names.withColumnRenamed("name", "p")).toDF("q_id", "entity_name")
        around = holding(names.withColumnRenamed("name", "k"), own.withColumnRenamed("q_id", "p")).toDF("entity_name", "q_id")
        return inside.unionByName(around).withColumn("score", F.lit(score))

    found = either(queries, "query", 1.0).unionByName(either(terms, "term", 0.8)).groupBy("q_id", "entity_name").agg(F.max("score").alias("score"))
    rest = close.withColumn("_n", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), "entity_name"))).where((F.col("_n") <= 2 * k) & (F.col("cosine") > 0.5))
    rest = rest.join(found.select("q_id").distinct(), "q_id", "left_anti").select("q_id", "entity_name", F.col("cosine").alias("score"))
    x = found.unionByName(rest).join(nodes, "entity_name")
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), F.desc("mention_count"), "entity_name")))
    return x.where(F.col("rank") <= k).select("q_id", "entity_name", "score", "rank")


def neighbourhoods(matched: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(q_id, same) of each question with a matched node, and (same, n_nodes, n_edges, context): the neighbourhood of these nodes, the edges within, and both as text, once for all questions that have the same.

    Questions with the same matched nodes have one neighbourhood; those of different ones often are alike too: they are told apart by how many nodes they have and two sums of 64 bits over these.
    """
    seeds = matched.select("q_id", F.col("entity_name").alias("node")).distinct()
    asked = written(seeds.groupBy("q_id").agg(F.array_sort(F.collect_set("node")).alias("seeds")))
    sets = written(asked.groupBy("seeds").agg(F.min("q_id").alias("of")))
    seeds = sets.select("of", F.explode("seeds").alias("node"))
    around = neighbours(edges, seeds.select(F.col("node").alias("start")).distinct(), hops, "src_id", "tgt_id")
    members = written(seeds.union(seeds.join(around.select(F.col("start").alias("node"), F.col("node").alias("other")), "node").select("of", "other")).distinct())
    total = lambda i: F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)"))
    alike = members.groupBy("of").agg(F.struct(F.count("*").alias("n"), total(0).alias("a"), total(1).alias("b")).alias("is"))
    alike = alike.join(alike.groupBy("is").agg(F.min("of").alias("same")), "is").select("of", "same")
    which = written(asked.join(sets, "seeds").join(alike, "of").select("q_id", "same"))
    members = members.join(which.select(F.col("same").alias("of")).distinct(), "of", "left_semi").withColumnRenamed("of", "same")
    inside = edges.join(members.withColumnRenamed("node", "src_id"), "src_id").join(members.withColumnRenamed("node", "tgt_id"), ["same", "tgt_id"])
    comma = lambda c: F.replace(c, F.lit(SEP), F.lit(", "))
    said = nodes.join(members, nodes.entity_name == members.node).select("same", F.lit(0).alias("kind"), node_text().alias("text"))
    linked = inside.select("same", F.lit(1).alias("kind"), F.concat("src_id", F.lit(" - "), "tgt_id", F.lit(": "), comma("description")).alias("text"))
    g = said.unionByName(linked).groupBy("same").agg(F.count_if(F.col("kind") == 0).alias("n_nodes"), F.count_if(F.col("kind") == 1).alias("n_edges"), F.array_sort(F.collect_list(F.struct("kind", "text"))).alias("c"))
    return which, written(g.select("same", "n_nodes", "n_edges", F.array_join(F.col("c.text"), "\n").alias("context")))


def beside(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked (q_id, same, ...) with the columns of texts (same, ...), null where there is none; texts are few and long.

    A text is sent to as many tasks as its questions are dealt to, so that no task has all of these. Questions come by and texts wait, whatever Spark makes of the sizes, as a left join has it: were it
    the other way round, a task would hold a row with the text for each of its questions at once.
    """
    long_rows_ready(asked.sparkSession)
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = written(asked.withColumn("_part", F.pmod(F.xxhash64("q_id"), F.lit(parts))))
    return q.join(texts.join(q.select("same", "_part").distinct(), "same"), ["same", "_part"], "left").drop("same", "_part")


def search(matched: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(q_id, n_nodes, n_edges, context): the matched nodes of each question with their neighbourhood, the edges within, and both as text.

    nodes as merge_nodes gives them, edges as merge_edges does.
    """
    asked, texts = neighbourhoods(matched, nodes, edges, hops)
    return beside(asked.join(texts.select("same"), "same", "left_semi"), texts).select("q_id", "n_nodes", "n_edges", "context")
