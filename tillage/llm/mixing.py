"""Operator 2: mix sources to target weights by hierarchical budgets (DataFrame functions only).

The tree has one level per column of ``levels`` (domain, language, source, ...). A token budget goes down from
the root: the children of a node share its budget in proportion to their weights, no child gets more
than its capacity (its tokens times ``max_epochs``), and what a short child leaves goes to its siblings in
proportion to their weights. Only when all children of a node are full does a shortage reach the node's own
siblings, because a node's capacity is the sum of its children's. All amounts are whole tokens, shares are
rounded down.

A leaf's quota is then taken from seeded epochs: as many whole passes over the leaf as fit, and of the next
pass the longest prefix, in an order seeded by epoch, whose tokens stay within the rest.

Scale: texts are read once to count tokens, afterwards only (id, leaf, tokens, order key) moves. A leaf is
cut into buckets by its order key, so a prefix sum over the buckets decides nearly all documents and
only the one bucket per leaf that holds the end of the prefix needs a running sum over documents; a leaf
with a third of all rows is spread over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.shared import stored, text_or_empty

MISSING = "(none)"
BUCKET_ROWS = 4096
MAX_EPOCHS = 4


def count_tokens(text: Column) -> Column:
    """Tokens of a text: its runs of characters other than white space (``\\s``)."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def path_weight(levels: list[str], weights: dict[tuple, int]) -> Column:
    """Weight of the node whose path the level columns hold; 1 where ``weights`` says nothing."""
    own = {p: w for p, w in weights.items() if len(p) == len(levels)}
    if not own:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for p, w in own.items() for x in ("\x1f".join(p), int(w))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *levels)), F.lit(1)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``quota``: each parent's ``budget`` shared among its rows by ``weight`` within ``capacity``.

    Children in order of capacity per weight: a child is full as long as its proportional share of what is
    left reaches its capacity; the others split what then remains. A weight of 0 gets nothing.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(F.col("_ratio"), F.col(name))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = (children
         .withColumn("_cap", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
         .withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap").cast("double") / F.col("weight")).otherwise(F.lit(0.0)))
         .withColumn("_left", F.col("budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_weights", F.sum("weight").over(onward))
         .withColumn("_at", F.row_number().over(ordered))
         .withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("weight"))
         .withColumn("_cut", F.min(F.when(~F.col("_full"), F.struct("_at", "_left", "_weights"))).over(w)))
    share = F.expr("_cut._left * weight div _cut._weights")
    return d.withColumn("quota", F.when(F.col("_cut").isNull() | (F.col("_at") < F.col("_cut._at")), F.col("_cap"))
                        .otherwise(share)).drop("_cap", "_ratio", "_left", "_weights", "_at", "_full", "_cut")


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: dict[tuple, int], budget_percent: int,
                max_epochs: int) -> DataFrame:
    """One row per leaf: the level columns, ``tokens``, ``n_docs``, ``quota``. ``leaves`` has tokens and n_docs.

    The tables here have one row per node of the tree, a property of the metadata and not of the rows.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.sum("capacity").alias("_all"), F.sum("tokens").alias("_tokens")).select(
        F.least(F.expr(f"_tokens * {int(budget_percent)} div 100"), F.col("_all")).alias("budget"))
    budgets: DataFrame | None = None
    for k, name in enumerate(levels):
        path, parent = levels[:k + 1], levels[:k]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")) \
            .withColumn("weight", path_weight(path, weights))
        nodes = nodes.crossJoin(F.broadcast(total)) if budgets is None else nodes.join(budgets, parent)  # total: one row
        budgets = share_out(nodes, parent, name).select(*path, F.col("quota").alias("budget"))
    return leaves.join(budgets.withColumnRenamed("budget", "quota"), levels).select(
        *levels, "tokens", "n_docs", "quota")


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch: md5 of id, seed and epoch, as text."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit(MISSING)), F.lit(str(seed)), epoch.cast("string")))


def select_mixture(docs: DataFrame, levels: list[str], weights: dict[tuple, int], budget_percent: int = 60,
                   max_epochs: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id",
                   text_col: str = "text", tie: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, the level columns, ``n_tokens``, ``leaf_tokens``, ``leaf_quota`` and
    ``epochs``, the number of times the document is taken (0: not at all). With ``tie``, an expression over ``docs`` that orders
    rows of one id, also ``tie``.

    ``levels`` are columns of ``docs``; a null there is a node of its own, named "(none)". A null text has 0 tokens,
    and documents without tokens come with the prefix they fall into. Rows that repeat an id are separate rows
    in the same place of the order. An empty table gives an empty result; other columns are ignored.
    """
    narrow = stored(docs.select(
        F.col(id_col).alias("_id"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"_level{k}") for k, c in enumerate(levels)],
        *([] if tie is None else [tie.alias("tie")]), count_tokens(text_or_empty(text_col)).alias("n_tokens")), "mix-docs")
    names = [f"_level{k}" for k in range(len(levels))]
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    quotas = stored(leaf_quotas(leaves, names, weights, budget_percent, max_epochs).select(
        *names, "tokens", "n_docs", "quota",
        F.when(F.col("tokens") > 0, F.expr("quota div nullif(tokens, 0)")).otherwise(F.lit(0)).alias("whole"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.nullif(F.col("tokens"), F.lit(0))).otherwise(F.lit(0)).alias("rest"),
        # Buckets of about BUCKET_ROWS documents: a power of two up to 2^28, from the first 32 bits of the key.
        F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(28), F.ceil(F.log2(F.col("n_docs") / F.lit(BUCKET_ROWS)))))).cast("long").alias("buckets"),
    ), "mix-quotas")
    d = narrow.join(quotas, names).withColumn("_key", order_key(F.col("_id"), seed, F.col("whole"))).withColumn(
        "_bucket", F.expr("CAST(conv(substring(_key, 1, 8), 16, 10) AS BIGINT) * buckets div 4294967296L"))
    by_leaf = Window.partitionBy(*names).orderBy("_bucket")
    sums = d.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_in"), F.first("rest").alias("_rest")) \
        .withColumn("_before", F.coalesce(F.sum("_in").over(by_leaf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .select(*names, "_bucket", "_before", F.when(F.col("_before") + F.col("_in") <= F.col("_rest"), F.lit("all"))
                .when(F.col("_before") > F.col("_rest"), F.lit("none")).otherwise(F.lit("some")).alias("_taken"))
    d = d.join(sums, [*names, "_bucket"])
    running = Window.partitionBy(*names, "_bucket").orderBy("_key", "_id", "n_tokens", *([] if tie is None else ["tie"])).rowsBetween(Window.unboundedPreceding, 0)
    cut = d.where(F.col("_taken") == "some").withColumn(
        "_in_prefix", F.col("_before") + F.sum("n_tokens").over(running) <= F.col("rest"))
    clear = d.where(F.col("_taken") != "some").withColumn("_in_prefix", F.col("_taken") == "all")
    both = cut.unionByName(clear)
    # A quota that is a whole number of passes takes nothing of the next pass, not even documents without tokens.
    more = F.when(F.col("_in_prefix") & (F.col("rest") > 0), F.lit(1)).otherwise(F.lit(0))
    return both.select(
        F.col("_id").alias(id_col), *[F.col(f"_level{k}").alias(c) for k, c in enumerate(levels)], *([] if tie is None else ["tie"]), "n_tokens",
        F.col("tokens").alias("leaf_tokens"), F.col("quota").alias("leaf_quota"), (F.col("whole") + more).alias("epochs"))


def source_domain(source: Column) -> Column:
    """Domain of a source of the documents table, from the number that ends its name (five sources a domain)."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1).try_cast("int")
    return F.when(number < 5, F.lit("web")).when(number < 10, F.lit("books")).when(number < 15, F.lit("code")) \
        .when(number.isNotNull(), F.lit("news")).otherwise(F.lit(MISSING))


# Target weights of the registered query and of the pipeline: domains, then languages within a domain.
DOMAIN_WEIGHTS = {("web",): 3, ("books",): 4, ("code",): 2, ("news",): 1}
LANGUAGE_WEIGHTS = {(d, lang): w for d in ("web", "books", "code", "news") for lang, w in
                    (("en", 6), ("de", 2), ("fr", 2), ("es", 2))}
WEIGHTS = DOMAIN_WEIGHTS | LANGUAGE_WEIGHTS
LEVELS = ["domain", "lang", "source"]


def with_domain(docs: DataFrame) -> DataFrame:
    """Level columns of the documents table; an own ``domain`` column is replaced."""
    return docs.withColumn("domain", source_domain(F.col("source")))


def mixture_rows(docs: DataFrame, budget_percent: int, max_epochs: int = 1, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that a mixture without repetition takes, with all their columns.

    Rows that repeat an id with other texts or levels are taken each for itself. Rows that repeat id, text and levels are taken
    together or not at all, so that the budget holds.
    """
    levels = docs.select("doc_id", "text", "lang", "source")
    tie = F.xxhash64("text")
    taken = select_mixture(with_domain(levels), LEVELS, WEIGHTS, budget_percent, max_epochs, seed, tie=tie)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in ("lang", "source")]
    whole = taken.groupBy("doc_id", "lang", "source", "tie").agg(F.min("epochs").alias("_least")).where(F.col("_least") > 0).select(
        F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("tie").alias("__tie"))
    # A null id meets the null id; the other keys are never null.
    return docs.join(whole, docs["doc_id"].eqNullSafe(whole["__id"]) & (keys[0] == whole["__lang"]) & (keys[1] == whole["__source"])
                     & (tie == whole["__tie"]), "left_semi")


# The same rules in DuckDB.
def mixture_sql(budget_percent: int, max_epochs: int, seed: int, docs: str = "documents") -> str:
    """SELECT of select_mixture() with LEVELS and WEIGHTS over ``docs``."""
    def weight(path):
        own = [(p, w) for p, w in WEIGHTS.items() if len(p) == len(path)]
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(path, p, strict=True)) + f" THEN {w}" for p, w in own)
        return f"CAST(CASE {cases} ELSE 1 END AS BIGINT)" if own else "CAST(1 AS BIGINT)"

    ctes = [f"""mix_docs AS (
  SELECT doc_id, coalesce(lang, '{MISSING}') AS lang, coalesce(source, '{MISSING}') AS source,
         CASE WHEN num < 5 THEN 'web' WHEN num < 10 THEN 'books' WHEN num < 15 THEN 'code'
              WHEN num IS NOT NULL THEN 'news' ELSE '{MISSING}' END AS domain, n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INTEGER) AS num,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM {docs}))""",
            f"""leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens,
  CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS capacity FROM mix_docs GROUP BY ALL)""",
            f"total AS (SELECT least(CAST(sum(tokens) AS BIGINT) * {budget_percent} // 100, CAST(sum(capacity) AS BIGINT)) AS budget FROM leaves)"]
    for k, name in enumerate(LEVELS):
        path, parent = LEVELS[:k + 1], LEVELS[:k]
        cols = ", ".join(path)
        src = "CROSS JOIN total" if k == 0 else f"JOIN budget{k - 1} USING ({', '.join(parent)})"
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        ctes += [f"""nodes{k} AS (SELECT n.*, budget, capacity * 1.0::DOUBLE / weight AS ratio FROM (
  SELECT {cols}, CAST(sum(capacity) AS BIGINT) AS capacity, {weight(path)} AS weight FROM leaves GROUP BY {cols}) n {src})""",
                 f"""filled{k} AS (SELECT *, budget - coalesce(CAST(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_over,
  CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights, row_number() OVER w AS spot
  FROM nodes{k} WINDOW w AS ({part} ORDER BY ratio, {name}))""",
                 f"""marked{k} AS (SELECT *, min(CASE WHEN NOT capacity * weights <= left_over * weight THEN spot END) OVER ({part}) AS cut FROM filled{k})""",
                 f"""budget{k} AS (SELECT {', '.join('m.' + c for c in path)},
  CASE WHEN m.cut IS NULL OR m.spot < m.cut THEN m.capacity ELSE c.left_over * m.weight // c.weights END AS budget
  FROM marked{k} m LEFT JOIN marked{k} c ON c.spot = m.cut {' '.join(f'AND c.{p} = m.{p}' for p in parent)})"""]
    ctes.append(f"""placed AS (
  SELECT d.doc_id, d.domain, d.lang, d.source, d.n_tokens, l.tokens AS leaf_tokens, b.budget AS leaf_quota,
         CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS whole,
         CASE WHEN l.tokens > 0 THEN b.budget % l.tokens ELSE 0 END AS rest
  FROM mix_docs d JOIN leaves l USING (domain, lang, source) JOIN budget{len(LEVELS) - 1} b USING (domain, lang, source))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_quota,
       CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (
         PARTITION BY domain, lang, source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '{MISSING}') || ':{seed}:' || CAST(whole AS VARCHAR)), doc_id, n_tokens
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM placed"""
