"""Readers and writers of documents and graphs: JSON lines, JSON, CSV, text, GraphML, audit lines, training splits."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_corrupt"


def read_documents(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of a .jsonl, .json or .csv path (or `fmt`); lines that don't parse are left out.

    The id is the first of id, doc_id, _id; the text the first of text, content, contents, with a title above it.
    """
    fmt = fmt or path.rsplit(".", 1)[-1]
    names = ("id", "doc_id", "_id", "title", "text", "content", "contents")
    if fmt == "csv":
        raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    else:
        schema = ", ".join(f"{n} string" for n in (*names, BAD))
        raw = spark.read.schema(schema).option("multiLine", str(fmt == "json").lower()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
        raw = raw.where(F.col(BAD).isNull()).drop(BAD)
    return normalize_documents(raw)


def normalize_documents(raw: DataFrame) -> DataFrame:
    """The id and text columns whatever the source calls them; rows without a text are left out."""
    have = {c.lower() for c in raw.columns}
    first = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    text, title = first("text", "content", "contents"), first("title")
    whole = F.when(title.isNotNull() & (title != ""), F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    return raw.select(first("id", "doc_id", "_id").alias("doc_id"), whole.alias("text")).where("text is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, kind, text): whole files, dispatched by extension; the text of .docx files is taken from their XML.

    kind is text, html, docx, pdf, image or unknown. Kinds without a parser here (pdf, image, unknown) and broken .docx
    files have a null text, never their bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    kind = F.when(ext.isin("txt", "md", "log"), "text").when(ext.isin("html", "htm"), "html").when(ext == "docx", "docx")
    kind = kind.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff"), "image").otherwise("unknown")
    files = files.select("path", kind.alias("kind"), "content")
    plain = files.where("kind <> 'docx'").select("path", "kind", F.when(F.col("kind").isin("text", "html"), F.decode("content", "UTF-8")).alias("text"))
    return plain.unionByName(files.where("kind = 'docx'").mapInPandas(_docx_texts, "path string, kind string, text string"))


def _docx_texts(batches):
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for pdf in batches:
        texts = []
        for content in pdf["content"]:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                texts.append(None)
        yield pdf[["path", "kind"]].assign(text=texts)


def load_checked(load: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] | None = None, attempts: int = 3, wait: float = 0.1, skip: bool = False) -> DataFrame | None:
    """What `load` gives, if it can be read and is valid; tried again after wait, 2 wait, ... seconds, then raised, or None with skip."""
    for k in range(1, attempts + 1):
        try:
            df = load()
            df.take(1)
            if valid is not None and not valid(df):
                raise ValueError("the loaded rows aren't valid")
            return df
        except Exception:
            if k < attempts:
                time.sleep(wait * k)
            elif not skip:
                raise
    return None


def load_files(spark: SparkSession, paths: list[str], **options) -> tuple[DataFrame | None, list[str]]:
    """The documents of several files and the paths that failed; options: those of load_checked()."""
    loaded = {p: load_checked(lambda p=p: read_documents(spark, p), **{"skip": True, **options}) for p in paths}
    good = [df.withColumn("source_path", F.lit(p)) for p, df in loaded.items() if df is not None]
    return (reduce(DataFrame.unionByName, good) if good else None), [p for p, df in loaded.items() if df is None]


def byte_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Rows (path, chunk, bytes) of files cut into pieces of `size` bytes, the last one shorter."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    rows = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("chunk"))
    return rows.select("path", "chunk", F.substring("content", F.col("chunk") * size + 1, F.lit(size)).alias("bytes"))


def graph_from_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, text) and edges (src, dst, kind) of JSON lines with id, label, text, citations, references.

    Edges lead to ids that exist; lines without an id are left out.
    """
    from lumenquarry.operators.knowledge import reference_edges

    schema = "id string, label string, text string, citations array<string>, references array<string>"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("id is not null")
    edges = reference_edges(rows, {"cites": F.col("citations"), "refers": F.col("references")}, "id")
    return rows.select("id", "label", "text").dropDuplicates(["id"]), edges


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of lines of the files that come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def write_index(postings: DataFrame, path: str, buckets: int = 16) -> None:
    """Rebuild an inverted index: postings in folders by term hash, so that a lookup prunes to one."""
    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    bucketed.repartition("bucket").sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_terms(spark: SparkSession, path: str, terms: list[str], buckets: int = 16) -> DataFrame:
    """Postings of some terms; only their buckets are read."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("b")).distinct()
    keep = [r["b"] for r in wanted.collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(*keep) & F.col("term").isin(*terms)).drop("bucket")


def index_is_valid(postings: DataFrame, path: str) -> bool:
    """True if the written index holds the same postings."""
    spark = postings.sparkSession
    back = spark.read.parquet(path).select(*postings.columns)
    return postings.exceptAll(back).isEmpty() and back.exceptAll(postings).isEmpty()


def xml_escaped(c: Column) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c.cast("string"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, line): node and edge elements of a GraphML document; write_graphml adds head and tail."""
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_escaped(F.col("id")), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_escaped(F.col("src")), F.lit('" target="'), xml_escaped(F.col("dst")), F.lit('"/>')).alias("line"))
    return n.unionAll(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Part files in order: head, nodes, edges, tail; their concatenation is the document."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, '<graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    ends.unionByName(graphml_lines(nodes, edges)).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_dataset(rows: DataFrame, split: str, path: str) -> None:
    """A folder of JSON lines per split, and one of counts."""
    rows.write.mode("overwrite").partitionBy(split).json(f"{path}/data")
    rows.groupBy(split).count().write.mode("overwrite").json(f"{path}/metadata")


def cef_line(vendor: str, product: str, event: Column, name: Column, severity: Column, fields: dict[str, Column]) -> Column:
    """A CEF audit line; pipes and backslashes of the header and equals signs of the fields are escaped."""
    head = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    value = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    ext = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), value(c)) for k, c in fields.items()])
    return F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit("1.0"), head(event), head(name), severity.cast("string"), ext)


def leef_line(vendor: str, product: str, event: Column, fields: dict[str, Column]) -> Column:
    """A LEEF audit line with tab-separated fields."""
    ext = F.concat_ws("\t", *[F.concat(F.lit(f"{k}="), F.translate(c.cast("string"), "\t\n", "  ")) for k, c in fields.items()])
    return F.concat_ws("|", F.lit("LEEF:2.0"), F.lit(vendor), F.lit(product), F.lit("1.0"), event.cast("string"), ext)


def export_with_manifest(rows: DataFrame, line: Column, path: str) -> None:
    """Audit lines as text, and a manifest (rows, digest over the line hashes in order) beside them."""
    lines = rows.select(line.alias("line"))
    lines.write.mode("overwrite").text(f"{path}/lines")
    h = F.sha2("line", 256)
    lines.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.substring(h, 1, 16)))), 256).alias("digest")).write.mode("overwrite").json(f"{path}/manifest")
