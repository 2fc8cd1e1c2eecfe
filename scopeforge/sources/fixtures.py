"""Driver tables as engine inputs (see FIXTURES.md §2).

The engine's real inputs are syntax-node tables produced by an external parser.
For tests and benchmarks the driver's generated tables are mapped onto the
engine's schemas here, with Spark jobs only, so every query's work grows with
the tables.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_starts, token_starts
from ..operators.skew import shuffled
from ..session import materialize, qualified

# Fixture parameters (FIXTURES.md §2.1): node kind of a token by its index mod 24.
DOC_TOKEN_KINDS = ["Class", "Const", "Send", "Lvar", "Def", "Ivar", "Send", "Arg", "Lvasgn",
                   "Const", "CSend", "Sym", "Module", "Gvar", "Gvasgn", "Lvar", "Ivasgn", "Super",
                   "Alias", "Cvar", "Defs", "Cvasgn", "Casgn", "ZSuper"]
# Token positions (mod 24) whose symbol gets a receiver (class) scope.
CLASS_SCOPE_SLOTS = [6, 9]
SEQ_LINE_SHIFT = 1 << 32          # seq = line * 2^32 + token index
NAME_TRIM = ".,"                  # trailing characters stripped from a token's name


def row(names: list[str], *values) -> "F.Column":
    """A struct with the given field names (elements of one array must agree)."""
    return F.struct(*[v.alias(n) for n, v in zip(names, values)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow, CPU-heavy stage at least one task per core.

    A small file with few row groups yields fewer input splits than cores; then the
    rows are dealt round-robin over ``defaultParallelism`` tasks.  With many input
    splits (the normal case at scale) nothing changes and nothing is shuffled."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:          # no RDD view (e.g. a Connect session): leave as is
        return df
    return df.repartition(par) if splits < par else df


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line, line_text, line_start (character offset), line_len.

    Line starts come from the newline positions of the text in the same row, so no
    shuffle or per-document window is needed.
    """
    d = spread(docs).select("doc_id", "lang", "source", "text",
                    F.split("text", "\n", -1).alias("_lines"),
                    token_starts("text", "\n").alias("_starts"))
    d = d.select("doc_id", "lang", "source",
                 F.posexplode(F.arrays_zip(F.col("_lines").alias("line_text"),
                                           F.col("_starts").alias("line_start"))).alias("line", "_z"))
    return d.select("doc_id", "lang", "source", F.col("line").cast("bigint").alias("line"),
                    F.col("_z.line_text").alias("line_text"),
                    F.col("_z.line_start").cast("bigint").alias("line_start"),
                    F.length("_z.line_text").cast("bigint").alias("line_len"))


def document_tokens(docs: DataFrame, dealt: bool = False, keep: tuple[str, ...] = (), **of_line: "F.Column") -> DataFrame:
    """One row per blank-separated token: doc_id, lang, source, line, tok_ix, tok, start_col.
    ``dealt``: the rows are spread over tasks already, and stay there.  ``keep``: columns of the
    document to keep.  ``of_line``: further columns of (doc_id, lang, source, line), made once per line."""
    lines = (docs if dealt else spread(docs)).select("doc_id", "lang", "source", *keep,
                                F.posexplode(F.split("text", "\n", -1)).alias("line", "line_text"))
    # the start columns are one array per line, of which a token takes its own
    toks = lines.select("doc_id", "lang", "source", F.col("line").cast("bigint").alias("line"), "line_text",
                        blank_starts("line_text").alias("starts"), *keep, *[c.alias(n) for n, c in of_line.items()])
    toks = toks.select("doc_id", "lang", "source", "line", "starts", *keep, *of_line,
                       F.posexplode(F.split("line_text", " ", -1)).alias("tok_ix", "tok"))
    return toks.select("doc_id", "lang", "source", "line",
                       F.col("tok_ix").cast("bigint").alias("tok_ix"), "tok",
                       F.get("starts", F.col("tok_ix")).cast("bigint").alias("start_col"), *keep, *of_line)


def token_nodes(docs: DataFrame, dealt: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens as syntax nodes with a kind and (for aliases) a slot, plus the fixture's
    scope columns and columns of the document to ``keep``.  Input of the emission step."""
    t = document_tokens(
        docs, dealt, path_parts=F.array("source", "lang", F.col("doc_id").cast("string")),
        scope_path=F.when(F.col("line") == 0, F.array("lang", "source"))
        .otherwise(F.array("lang", "source", F.concat(F.lit("m"), (F.col("line") % 3).cast("string")))),
        own_class=F.array("source"), keep=keep)
    kinds = F.array(*[F.lit(k) for k in DOC_TOKEN_KINDS])
    m = F.col("tok_ix") % F.lit(len(DOC_TOKEN_KINDS))
    kind = F.element_at(kinds, (m + 1).cast("int"))
    return t.select(
        F.col("doc_id").alias("file_id"),
        (F.col("line") * F.lit(SEQ_LINE_SHIFT) + F.col("tok_ix")).alias("seq"),
        "path_parts",
        kind.alias("kind"),
        F.when(kind == "Alias", F.when(F.col("line") % 2 == 0, F.lit("to")).otherwise(F.lit("from")))
        .alias("slot"),
        "scope_path",
        F.when(m.isin(CLASS_SCOPE_SLOTS), F.col("own_class")).otherwise(F.array().cast("array<string>"))
        .alias("class_scope"),
        F.lower(F.rtrim("tok", F.lit(NAME_TRIM))).alias("name"),
        "line", "start_col",
        (F.col("start_col") + F.length("tok")).cast("bigint").alias("end_col"),
        *([] if "user_space" in keep else [(F.col("doc_id") % 10 != 0).alias("user_space")]),
        "tok_ix", *keep)


SYMBOL_COLUMNS = ["file_id", "seq", "path_parts", "category", "scope_path", "class_scope",
                  "name", "node_type", "line", "start_col", "end_col", "user_space"]


def document_symbols(spark: SparkSession, docs: DataFrame, dealt: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Symbols of the documents fixture: token nodes -> EXT-1 emission -> EXT-10 drop; with
    columns of the documents to ``keep``."""
    from .. import rules
    from ..operators.extract import drop_nameless, emit
    sym = emit(token_nodes(docs, dealt, keep), rules.emit_rules(spark))
    return drop_nameless(sym).select(*SYMBOL_COLUMNS, *[c for c in keep if c not in SYMBOL_COLUMNS])


# ---------------------------------------------------------------------------
# Lines as scope frames (FIXTURES.md §2.2)
FRAME_BLOCK = 1 << 32       # numbers of a line
BLOCK_ROOT_SLOT = 11        # tokens at index mod 24 = 11 are block roots
BLOCK_SPAN = 17             # a block root holds the next five tokens


def frame_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token nodes, frames) with nested-set numbers.

    Token node: pre = (line + 1) * 2^32 + 3 * tok_ix + 1, post = pre + 1; a line of a
    Spark string has fewer than 2^31 characters, so its numbers stay below the next
    line's.  Frames:
    one class frame per document (pre 0, covering all lines) named by the first
    token, and one def frame per line named by the line's first token; frames
    exist only when that token has a name.
    """
    clean = lambda tok: F.lower(F.rtrim(tok, F.lit(NAME_TRIM)))
    d = spread(docs).select(F.col("doc_id").alias("file_id"), F.split("text", "\n", -1).alias("lines"))
    t = d.select("file_id", F.posexplode("lines").alias("line", "text")).select(
        "file_id", F.col("line").cast("bigint").alias("line"), F.posexplode(F.split("text", " ", -1)).alias("tok_ix", "tok"))
    nodes = t.select("file_id", "line", F.col("tok_ix").cast("bigint").alias("tok_ix"), clean(F.col("tok")).alias("name"),
                     ((F.col("line") + 1) * F.lit(FRAME_BLOCK) + F.lit(3) * F.col("tok_ix") + 1).alias("pre"))
    nodes = nodes.withColumn("post", F.col("pre") + 1)
    # the first token of a line, without cutting the rest
    named = lambda line: clean(F.substring_index(line, " ", 1))
    defs = d.select("file_id", F.posexplode(F.transform("lines", named)).alias("line", "name")).filter(F.col("name") != "").select(
        "file_id", ((F.col("line").cast("bigint") + 1) * F.lit(FRAME_BLOCK)).alias("pre"),
        ((F.col("line").cast("bigint") + 1) * F.lit(FRAME_BLOCK) + F.lit(FRAME_BLOCK - 1)).alias("post"),
        "name", F.lit("Def").alias("kind"))
    cls = d.select("file_id", F.lit(0).cast("bigint").alias("pre"),
                   ((F.size("lines") + 1) * F.lit(FRAME_BLOCK) + F.lit(FRAME_BLOCK - 1)).cast("bigint").alias("post"),
                   named(F.col("lines")[0]).alias("name"), F.lit("Class").alias("kind")).filter(F.col("name") != "")
    return nodes, cls.unionByName(defs)


def frame_symbols(docs: DataFrame, slots: list[int]) -> DataFrame:
    """Named token nodes at the given token positions (mod 24), with their kind."""
    nodes, _ = frame_nodes(docs)
    kinds = F.array(*[F.lit(k) for k in DOC_TOKEN_KINDS])
    m = F.col("tok_ix") % F.lit(len(DOC_TOKEN_KINDS))
    return (nodes.filter(m.isin(slots) & (F.col("name") != ""))
            .withColumn("kind", F.element_at(kinds, (m + 1).cast("int")))
            .withColumn("seq", F.col("line") * F.lit(SEQ_LINE_SHIFT) + F.col("tok_ix")))


# ---------------------------------------------------------------------------
# Star schema as call trees (FIXTURES.md §2.3)
PRIORITY_METHODS = [("1-URGENT", "attr_accessor"), ("2-HIGH", "attr_writer"),
                    ("3-MEDIUM", "attr_reader"), ("4-NOT SPECIFIED", "alias_method"),
                    ("5-LOW", "has_many")]
ARG_BASE = 10               # node id / pre of argument i = ARG_BASE + i
LINEITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def numbered_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``arg_ix``: 0-based number within the order over all columns
    ((l_orderkey, l_linenumber) is not unique in the driver tables)."""
    from ..operators.ranges import sequence_in_group
    li = table(spark, sf_dir, "lineitem")
    # numbered block-wise (blocks of line numbers, the leading sort key), so one
    # order holding a large share of all line items is not sorted in one task
    return sequence_in_group(li, ["l_orderkey"], "l_linenumber", [F.col(c) for c in LINEITEM_ORDER],
                             out="arg_ix", block=64)


def customer_const_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per customer: Const c_name -> (scope) Const n_name -> (scope) Const r_name."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    x = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    f = ["node_id", "parent_id", "slot", "name"]
    rows = F.array(
        row(f, F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.col("c_name")),
        row(f, F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit("scope"), F.col("n_name")),
        row(f, F.lit(2).cast("bigint"), F.lit(1).cast("bigint"), F.lit("scope"), F.col("r_name")))
    out = x.select(F.col("c_custkey").alias("file_id"), F.explode(rows).alias("n"))
    return out.select("file_id", "n.node_id", "n.parent_id", "n.slot", F.lit("Const").alias("kind"),
                      "n.name").filter(F.col("name").isNotNull())


def call_tree_nodes(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One file per order: a Send (method from the priority) whose receiver is the
    customer constant (a Const when the order status is F, else an Lvar) with its
    nation / region qualifiers, and one argument per line item (Sym for return
    flags A and N, else Str, named 'p' + part key).

    Columns: file_id, node_id, parent_id, slot, child_ix, kind, name, pre, post.
    """
    o = table(spark, sf_dir, "orders") if orders is None else orders
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    methods = spark.createDataFrame(PRIORITY_METHODS, "o_orderpriority string, method string")
    li = numbered_lineitems(spark, sf_dir)
    if orders is not None:
        li = li.join(shuffled(orders.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    # numbers are dense, so the last one of an order is told by its line items alone
    nargs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) - 1).alias("max_ix"))
    calls = (o.join(F.broadcast(methods), "o_orderpriority", "left")
             .join(shuffled(nargs), o.o_orderkey == nargs.l_orderkey, "left")
             .join(shuffled(c), o.o_custkey == c.c_custkey, "left")
             .join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left"))
    post0 = F.when(F.col("max_ix").isNotNull(), F.lit(ARG_BASE) + F.col("max_ix")).otherwise(F.lit(3))
    rk = F.when(F.col("o_orderstatus") == "F", F.lit("Const")).otherwise(F.lit("Lvar"))
    null_l = F.lit(None).cast("bigint")
    f = ["node_id", "parent_id", "slot", "child_ix", "kind", "name", "pre", "post"]
    L = lambda v: F.lit(v).cast("bigint")
    rows = F.array(
        row(f, L(0), null_l, F.lit(None).cast("string"), L(0), F.lit("Send"), F.col("method"), L(0),
            post0.cast("bigint")),
        row(f, L(1), L(0), F.lit("recv"), L(0), rk, F.col("c_name"), L(1), L(3)),
        row(f, L(2), L(1), F.lit("scope"), L(0), F.lit("Const"), F.col("n_name"), L(2), L(3)),
        row(f, L(3), L(2), F.lit("scope"), L(0), F.lit("Const"), F.col("r_name"), L(3), L(3)))
    heads = calls.select(F.col("o_orderkey").alias("file_id"), F.explode(rows).alias("n")) \
        .select("file_id", "n.*").filter((F.col("node_id") == 0) | F.col("name").isNotNull())
    args = li.select(
        F.col("l_orderkey").alias("file_id"), (F.lit(ARG_BASE) + F.col("arg_ix")).alias("node_id"),
        F.lit(0).cast("bigint").alias("parent_id"), F.lit("args").alias("slot"),
        F.col("arg_ix").alias("child_ix"),
        F.when(F.col("l_returnflag").isin("A", "N"), F.lit("Sym")).otherwise(F.lit("Str")).alias("kind"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
        (F.lit(ARG_BASE) + F.col("arg_ix")).alias("pre"), (F.lit(ARG_BASE) + F.col("arg_ix")).alias("post"))
    return heads.unionByName(args)


# ---------------------------------------------------------------------------
# Call trees inside programs (input of the whole extraction)
HEAD_NODES = 8              # numbers before the call tree's own
NODE_CHARS, LINE_CHARS = 16, 64


def program_nodes(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, lines): every order's call tree (of ``orders``, if given) as the body of a method in a class.

    class S<status>::Order, an alias (new name a symbol, old name one for even customers),
    and ``def run`` (``def self.run`` for odd customers) around the call.  A node with
    number ``pre`` stands at character 16 * (pre + 8); lines have 64 characters."""
    all_orders = table(spark, sf_dir, "orders") if orders is None else orders
    o = all_orders.select(F.col("o_orderkey").alias("file_id"), "o_orderstatus", "o_custkey")
    # written once: the heads and the lines of a program need the end of its tree
    tree = materialize(call_tree_nodes(spark, sf_dir, orders), "call-trees", lean=True).withColumn("parent_id", F.when(F.col("node_id") == 0, -2).otherwise(
        F.col("parent_id")).cast("bigint")).withColumn("slot", F.when(F.col("node_id") == 0, "body").otherwise(F.col("slot")))
    last = tree.filter("node_id = 0").select("file_id", F.col("post").alias("last"))
    odd = F.col("o_custkey") % 2 != 0
    f = ["node_id", "parent_id", "slot", "child_ix", "kind", "name", "pre", "post"]
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def head(i, parent, slot, kind, name, post):
        i, parent = F.lit(i).cast("bigint"), F.lit(parent).cast("bigint")
        return row(f, i, parent, slot, zero, kind, name, i, post.cast("bigint"))

    rows = F.array(
        head(-8, None, none, F.lit("Class"), none, F.col("last")),
        head(-7, -8, F.lit("name"), F.lit("Const"), F.lit("Order"), F.lit(-6)),
        head(-6, -7, F.lit("scope"), F.lit("Const"), F.concat(F.lit("S"), "o_orderstatus"), F.lit(-6)),
        head(-5, -8, F.lit("body"), F.lit("Alias"), none, F.lit(-3)),
        head(-4, -5, F.lit("to"), F.lit("Sym"), F.lit("fresh"), F.lit(-4)),
        head(-3, -5, F.lit("from"), F.when(odd, "Dsym").otherwise("Sym"), F.lit("old"), F.lit(-3)),
        head(-2, -8, F.lit("body"), F.when(odd, "Defs").otherwise("Def"), F.lit("run"), F.col("last")))
    heads = o.join(shuffled(last), "file_id").select("file_id", F.explode(rows).alias("n")).select("file_id", "n.*")
    begin = (F.col("pre") + HEAD_NODES) * NODE_CHARS
    end = begin + F.coalesce(F.length("name"), F.lit(1))
    nodes = tree.unionByName(heads).withColumns({
        "expr_begin": begin, "expr_end": end, "name_begin": F.when(F.col("name").isNotNull(), begin),
        "name_end": F.when(F.col("name").isNotNull(), end)})
    lines = last.select("file_id", F.posexplode(F.sequence(
        zero, F.floor((F.col("last") + HEAD_NODES + 2) * NODE_CHARS / LINE_CHARS) * LINE_CHARS,
        F.lit(LINE_CHARS).cast("bigint"))).alias("line", "line_start"))
    return nodes, lines.select("file_id", F.col("line").cast("bigint").alias("line"), "line_start",
                               F.lit(LINE_CHARS - 1).cast("bigint").alias("line_len"))


# ---------------------------------------------------------------------------
# Documents as a source tree on the shared file system (FIXTURES.md §2.6)
NODE_MODULES_SOURCES = ["src3"]     # written below a node_modules directory
BAD_UTF8_SOURCES = ["src7"]         # files start with an invalid UTF-8 byte


def write_document_tree(docs: DataFrame, path: str) -> None:
    """Write documents as text files ``top=<app|node_modules>/lang=../source=../``.

    Executors write the files; every file holds documents of one directory, one
    per line.  Files of ``BAD_UTF8_SOURCES`` get a leading 0xFF byte, which makes
    them invalid UTF-8."""
    bad = F.unhex(F.lit("FF")).cast("string")
    text = F.when(F.col("source").isin(BAD_UTF8_SOURCES), F.concat(bad, F.col("text"))).otherwise(F.col("text"))
    top = F.when(F.col("source").isin(NODE_MODULES_SOURCES), F.lit("node_modules")).otherwise(F.lit("app"))
    (docs.select(top.alias("top"), "lang", "source", text.alias("value"))
     .write.mode("overwrite").partitionBy("top", "lang", "source").text(path))


# ---------------------------------------------------------------------------
# Pages as source roots on the shared file system
LOCK_LINES = ["GEM", "  specs:", "    dep (1.0)", "      other (2.0)", "    rough (1.0)", "    gone (1.0)"]
#: Folder of a page, by its number: a workspace with a nested included folder, a pruned and
#: a passing one; a dependency, one with unreadable files, and one that no lockfile names.
PAGE_FOLDERS = [("app/src", "page_id % 8 IN (0, 1, 2)"), ("app/old", "page_id % 8 = 3"),
                ("app/shared", "page_id % 8 = 4"), ("app/tmp", "page_id % 8 = 5"),
                ("home/gems/dep-1.0", "page_id % 32 IN (14, 22, 30)"), ("home/gems/rough-1.0", "page_id % 32 = 6"),
                ("home/gems/other-2.0", "page_id % 8 = 7")]
NEW_PAGE = 1_000_000        # numbers of pages that come in the second pass
NEW_FOLDER = "app/new"
PAGE_BYTES = 32 << 20       # bytes of pages that a task writes
INTERFACE_SLOTS = (11, 16)  # tokens at index mod 24 in this range are a block and its content


def _folders(page: str = "page_id"):
    """Folder of a page, null for none."""
    return F.expr("CASE " + " ".join(f"WHEN {where.replace('page_id', page)} THEN '{folder}'" for folder, where in PAGE_FOLDERS) + " END")


def _write_pages(spark: SparkSession, pages: DataFrame, path: str, replace: bool = False) -> None:
    """One file ``<folder>/page=<number>/part-*.txt`` a page of (folder, page, text); with
    ``replace`` the files of folders that are there go.

    On a mounted file system the tasks write the files themselves: Spark's writer starts
    a process for the mode of every folder, file and checksum that it makes there."""
    from .roots import local_name, mounted
    pages = pages.filter(F.col("folder").isNotNull() & F.col("page").isNotNull())
    at = qualified(spark, path)
    if mounted([at]):
        size = pages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // PAGE_BYTES))
        dealt = pages.select("folder", "page", F.col("text").cast("binary").alias("text")).repartition(tasks, "folder", "page")
        wrote = dealt.sortWithinPartitions("folder", "page").mapInArrow(_page_writer(local_name(at), replace), "files long")
        wrote.agg(F.sum("files")).collect()
        return
    for folder, _ in PAGE_FOLDERS + [(NEW_FOLDER, "")]:
        # the files of a new folder are moved into place by the tasks that wrote them (version 2 of
        # the committer); version 1 and replacing leave that to the driver, one page after another
        rows = spread(pages.filter(F.col("folder") == folder)).select("page", F.col("text").alias("value"))
        out = rows.write.mode("overwrite").partitionBy("page")
        if replace:
            out.option("partitionOverwriteMode", "dynamic").text(f"{path}/{folder}")
        elif not rows.isEmpty():
            out.option("partitionOverwriteMode", "static").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{path}/{folder}")


def _page_writer(top: str, replace: bool):
    """Writes sorted pages below ``top``; rows of one page are lines of its file.  A file is
    written aside and renamed, so that a task that runs again leaves the same files."""
    def put(folder: str, page: int, lines: list[bytes]) -> None:
        at, own = f"{top}/{folder}/page={page}", f"part-{TaskContext.get().partitionId():05}.txt"
        os.makedirs(at, exist_ok=True)
        aside = f"{at}/.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(b"".join(line + b"\n" for line in lines))
        os.replace(aside, f"{at}/{own}")
        for name in os.listdir(at) if replace else ():
            if name != own:
                os.remove(f"{at}/{name}")

    def run(batches):
        own, lines, n = None, [], 0
        for batch in batches:
            for key, text in zip(zip(*(c.to_pylist() for c in batch.columns[:2])), batch.column(2).to_pylist()):
                if key != own and own is not None:
                    put(*own, lines)
                    lines, n = [], n + 1
                own = key
                lines.append(text)
        if own is not None:
            put(*own, lines)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return run


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.coalesce("html", F.lit("")).alias("html"))


def write_page_tree(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The roots as the first pass finds them."""
    bad = F.concat(F.unhex(F.lit("FF")).cast("string"), "html")
    pages = _pages(spark, sf_dir).withColumn("folder", _folders("page"))
    _write_pages(spark, pages.select("folder", "page", F.when(F.contains("folder", F.lit("rough")), bad).otherwise(F.col("html")).alias("text")), path)
    lock = spark.createDataFrame([("\n".join(LOCK_LINES),)], "value string")
    # compressed, so that its part file is no source file of the tree
    lock.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{path}/app/Gemfile.lock")


def change_page_tree(spark: SparkSession, sf_dir: str, path: str) -> None:
    """What happens before the second pass: files change (some no longer parse), a folder
    goes, files come, and the unreadable ones are mended."""
    from ..session import delete_path
    pages = _pages(spark, sf_dir)
    changed = F.when(F.col("page") % 32 == 0, F.concat(F.lit("changed "), "html")).otherwise(F.concat("html", F.lit(" ###")))
    edits = pages.filter("page % 16 = 0").select(F.lit("app/src").alias("folder"), "page", changed.alias("text"))
    mended = pages.filter("page % 32 = 6").select(F.lit("home/gems/rough-1.0").alias("folder"), "page", F.col("html").alias("text"))
    _write_pages(spark, edits.unionByName(mended), path, replace=True)
    _write_pages(spark, pages.filter("page % 8 = 1").select(
        F.lit(NEW_FOLDER).alias("folder"), (F.col("page") + NEW_PAGE).alias("page"), F.col("html").alias("text")), path)
    delete_path(spark, f"{path}/app/old")


def page_key():
    return F.regexp_extract("path", r"page=(\d+)", 1).cast("bigint")


def page_symbols(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Symbols of a tree's files, made where the files are: tokens as in the documents; a file
    that is indexed for its interface has none of its blocks (EXT-7)."""
    docs = files.select(F.col("file_id").alias("doc_id"), F.lit("tree").alias("lang"), F.lit("page").alias("source"), "text",
                        "user_space", "interface_only")
    own = document_symbols(spark, docs, dealt=True, keep=("user_space", "interface_only"))
    slot = F.col("seq") % SEQ_LINE_SHIFT % len(DOC_TOKEN_KINDS)
    return own.filter(~(F.col("interface_only") & slot.between(*INTERFACE_SLOTS))).select(*SYMBOL_COLUMNS)


def page_messages(files: DataFrame) -> DataFrame:
    """The parser's messages of a tree's files: ``###`` ends parsing, ``<br>`` is a warning."""
    zero = F.lit(0).cast("bigint")
    found = F.array(F.struct(F.lit("###").alias("mark"), F.lit(False).alias("parse_ok")),
                    F.struct(F.lit("<br>").alias("mark"), F.lit(True).alias("parse_ok")))
    return (files.withColumn("m", F.explode(found)).filter(F.expr("contains(text, m.mark)"))
            .select("file_id", zero.alias("start_line"), zero.alias("start_col"), zero.alias("end_line"), zero.alias("end_col"),
                    F.concat(F.lit("found "), "m.mark").alias("message"), "m.parse_ok"))


def edited_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(programs that an edit changes, with their new call; programs that it removes)."""
    gone = orders.filter("o_orderkey % 11 = 0")
    changed = orders.filter("o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0").withColumn("o_orderpriority", F.lit("1-URGENT"))
    return changed, gone


def program_symbols(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Symbols of the programs by the whole extraction, with their file columns."""
    from ..operators.extract import extract_symbols
    nodes, lines = program_nodes(spark, sf_dir, orders)
    found = extract_symbols(spark, nodes, materialize(lines, "program-lines", lean=True))
    return found.withColumn("path_parts", F.array(F.lit("app"), F.col("file_id").cast("string"))).withColumn(
        "user_space", F.col("file_id") % 10 != 0).select(*SYMBOL_COLUMNS)
