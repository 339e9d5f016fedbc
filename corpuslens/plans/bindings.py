"""The library's relations over the test tables: which columns play which part.

Every view covers its whole table. ``documents`` are files of the root ``source``;
``pages`` are files of a host; parts are files of the root ``brand`` and consecutive
lines of an order are their imports and calls; customers are packages, orders
their conversations, events their prepared maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.paths import index_language

# File endings dealt out to documents in turn.
ENDINGS = ("rs", "ts", "tsx", "js", "jsx", "py", "pyi", "go", "c", "h", "cpp", "hpp", "MD", "json", "txt", "d.ts")
CLONES = "/clones"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Short rows dealt out before text is made of them: a file of their table may be one row group, that is one task."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, key)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod("doc_id", F.lit(len(ENDINGS))) + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending)
    return d.select(
        F.col("source").alias("root_path"), path.alias("file_path"), index_language(path).alias("language"),
        (F.col("n_chars") * 1000).alias("mtime_ns"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: root is the host, path the URL path without query and fragment."""
    rest = F.regexp_replace("url", r"^[a-z]+://", "")
    clean = F.regexp_replace(rest, r"[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(clean, r"^[^/]*/", ""), r"/+$", "")
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract(clean, "^[^/]*", 0).alias("root_path"), path.alias("file_path"), "page_id",
        F.octet_length("html").cast("long").alias("size_bytes"), F.col("html").alias("content"),
    )


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of each order: (order, line, flag, a, b and their brands).

    An order has a bounded number of lines, so the window per order is small. Parts are no short list, so no copies of
    them are made and none are sent to the driver, however small their file is packed; of a part with many lines
    adaptive execution splits the lines.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = li.withColumn("b", F.lead("l_partkey").over(w)).where("b is not null").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("a"), "b"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").hint("merge")
    of = lambda key, brand: part.select(F.col("p_partkey").alias(key), F.col("p_brand").alias(brand))
    return pairs.join(of("a", "brand_a"), "a").join(of("b", "brand_b"), "b")


def part_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency relation: a part imports the next part of an order; other brands stay unresolved."""
    target = F.col("b").cast("string")
    return part_links(spark, sf_dir).select(
        F.col("brand_a").alias("root_path"), F.col("a").cast("string").alias("importer_file"),
        F.when(F.col("brand_a") == F.col("brand_b"), target).alias("importee_file"),
        target.alias("raw_target"), F.col("l_linenumber").alias("line"),
    )


def part_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as starts; as no short list they join by merging, whatever size their file lets Spark guess."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("root_path"), F.col("p_partkey").cast("string").alias("start")
    ).hint("merge")


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callsite relation: in each order the part is called by the next one of its brand."""
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "macro").otherwise("type_ref")
    return part_links(spark, sf_dir).select(
        F.col("brand_a").alias("root_path"), F.concat_ws("/", F.lit("o"), F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")).alias("caller_file"),
        F.col("l_linenumber").alias("caller_line"),
        F.when(F.col("brand_a") == F.col("brand_b"), F.col("b").cast("string")).alias("caller_symbol"),
        F.col("a").cast("string").alias("callee_name"), kind.alias("callee_kind"),
    )


def part_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit graph: the lesser part number of a linked pair is the parent of the greater."""
    pairs = part_links(spark, sf_dir).where("brand_a = brand_b and a < b").select(
        F.col("brand_a").alias("root_path"), F.col("b").cast("string").alias("sha"), F.col("a").cast("string").alias("parent")
    )
    alone = part_starts(spark, sf_dir).select("root_path", F.col("start").alias("sha"), F.lit(None).cast("string").alias("parent"))
    return pairs.unionByName(alone).distinct()


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small source file per order: Rust, Python or Go by its status.

    The priority's digit puts that many comment lines at the top.
    """
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.col("o_orderstatus")

    def text(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    rust = text(
        "use crate::customer_", c, ";\n", F.repeat(F.lit("// struct Note {\n"), n), "pub struct Order", k,
        " {\n    total: u64,\n}\n\nimpl Order", k, " {\n    pub fn total(&self) -> u64 {\n        customer_", c,
        "(self.total, \"fake(\")\n    }\n}\n",
    )
    python = text(
        "from .customer_", c, " import load\n", F.repeat(F.lit("# class Note:\n"), n), "class Order", k,
        ":\n    def total(self):\n        return load(", k, ")\n",
    )
    go = text(
        "package orders\n", F.repeat(F.lit("// func note() {\n"), n), "\ntype Order", k,
        " struct {\n\ttotal int\n}\n\nfunc (o *Order", k, ") Total() int {\n\treturn customer", c, "(o)\n}\n",
    )
    content = F.when(status == "F", rust).when(status == "O", python).otherwise(go)
    ending = F.when(status == "F", "rs").when(status == "O", "py").otherwise("go")
    path = F.concat(F.lit("src/order_"), k, F.lit("."), ending)
    narrow = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return dealt(narrow, "o_orderkey").select(
        F.substring("o_orderpriority", 3, 20).alias("root_path"), path.alias("file_path"),
        index_language(path).alias("language"), content.alias("content"),
        F.octet_length(content).cast("long").alias("size_bytes"),
    )


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order, JavaScript or C by its number, with a function per line of the order.

    Each function has a block within a block that calls its part; JavaScript puts them all into one class.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = dealt(li, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    k = F.col("l_orderkey").cast("string")

    def body(template: str) -> Column:
        """The template for each line, with its place for @ and its part for #."""
        return F.array_join(F.transform("parts", lambda p, i: F.replace(
            F.replace(F.lit(template), F.lit("@"), (i + 1).cast("string")), F.lit("#"), p["l_partkey"].cast("string"))), "")

    js = F.concat(F.lit("class Order"), k, F.lit(" {\n"), body("  item@(a) {\n    if (a) { // {{\n      pay#(a);\n    }\n  }\n"), F.lit("}\n"))
    c = F.concat(F.lit("struct order"), k, F.lit(" {\n    int total;\n};\n"), body(
        "static int item@(int a)\n{\n    while (a) { /* } */\n        a = pay#(a - 1);\n    }\n    return a;\n}\n"))
    even = F.col("l_orderkey") % 2 == 0
    path = F.concat(F.lit("src/nest_"), k, F.when(even, ".js").otherwise(".c"))
    return parts.select(
        F.lit("nest").alias("root_path"), path.alias("file_path"), index_language(path).alias("language"), F.when(even, js).otherwise(c).alias("content"),
    ).withColumn("size_bytes", F.octet_length("content").cast("long"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packages; those of one nation and segment share a clone."""
    c = table(spark, sf_dir, "customer").alias("c")
    n = table(spark, sf_dir, "nation")
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order")
    )
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(first, "c_custkey", "left")
    segment = F.lower("c_mktsegment")
    git = F.col("c_mktsegment") != "HOUSEHOLD"
    path = F.concat(F.lit(CLONES + "/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("/"), segment)
    born = F.coalesce("first_order", F.lit("1990-01-01").cast("timestamp_ntz")).cast("timestamp")
    return joined.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("identifier"),
        F.lower("c_name").alias("display_name"), F.when(git, "git").otherwise("local").alias("source_type"),
        F.when(git, F.concat(F.lit("https://host.example/"), F.col("n_nationkey").cast("string"), F.lit("/"), segment)).alias("source_url"),
        F.when(F.col("c_acctbal") > 5000, "main").alias("source_branch"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("/home"), path)).otherwise(path).alias("path"),
        (F.col("c_acctbal") >= 0).alias("auto_pull"),
        F.when(F.col("c_acctbal") < 1000, "alpha").when(F.col("c_acctbal") > 9000, "gamma").alias("harness"),
        (F.col("c_acctbal") < 0).alias("shallow"),
        F.when(F.col("c_mktsegment") == "BUILDING", "branch").otherwise("global").alias("prepare_scope"),
        born.alias("created_at"), born.alias("updated_at"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversations of customers."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("package_id"),
        F.concat(F.lit("What about order "), F.col("o_orderkey").cast("string"), F.lit(" of priority "), F.col("o_orderpriority"), F.lit("?")).alias("question"),
        F.lit("alpha").alias("harness"), F.when(status == "F", 0).when(status == "O", 1).alias("exit_code"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("log_path"),
        F.lit(None).cast("string").alias("git_commit_sha"), F.lit(None).cast("string").alias("git_branch"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prepared maps of users; views have no branch."""
    e = table(spark, sf_dir, "events")
    branch = F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("package_id"),
        F.concat(F.lit("map "), F.col("props"), F.lit("\n")).alias("content"), F.col("ts").cast("timestamp").alias("created_at"),
        F.lit("alpha").alias("harness"), F.lit(None).cast("string").alias("model"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("git_commit_sha"), branch.alias("git_branch"),
        F.when(branch.isNull(), "global").otherwise("branch").alias("prepare_scope_at_time"),
    )
