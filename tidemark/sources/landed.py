"""Readers that shape landed files, and writers. Remote services are not called: their answers are landed as files first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import unescape

# Exhibit types in order of preference, and the form of a document table's entries.
EXHIBITS = ["EX-99.1", "EX-99", "EX-99.2"]
DOCUMENT_ENTRY = r"<TYPE>([^<\n]+)\n<SEQUENCE>(\d+)\n<FILENAME>([^<\n]+)"


def read_jsonl(spark: SparkSession, path: str, schema: str, reviewed: str | None = "_reviewed") -> DataFrame:
    """JSON lines with a given schema, empty lines left out; with reviewed, only rows where it is true. A broken line is an error, with
    the number of such lines, and so is a file without a reviewed row."""
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    bad = rows.where("_broken is not null").count()
    if bad:
        raise ValueError(f"{bad} lines of {path} are no JSON of this schema")
    rows = rows.drop("_broken")
    if reviewed:
        rows = rows.where(F.col(reviewed))
        if rows.isEmpty():
            raise ValueError(f"no reviewed row in {path}")
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(accession, text) of a folder of {accession}.txt files."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("accession"), F.col("value").alias("text")).where("accession != ''")


def filing_rows(blocks: DataFrame, arrays: list[str], key: str = "accessionNumber") -> DataFrame:
    """Rows of struct-of-arrays blocks: as many as the key array has, shorter or missing arrays padded with ''. Other columns are repeated."""
    others = [c for c in blocks.columns if c not in arrays]
    out = blocks.withColumn("z", F.explode(F.arrays_zip(*[F.coalesce(a, F.array()).alias(a) for a in arrays]))).where(F.col(f"z.{key}").isNotNull())
    return out.select(*others, *[F.coalesce(F.col(f"z.{a}"), F.lit("")).alias(a) for a in arrays])


def select_filings(rows: DataFrame, item: str, start: str, end: str, form: str = "8-K") -> DataFrame:
    """Filings of a form that name an item, filed from start to end inclusive; an empty report date is the filing date."""
    some = rows.where((F.col("form") == form) & F.col("items").contains(item) & F.col("filingDate").between(start, end))
    return some.withColumn("reportDate", F.coalesce(F.nullif("reportDate", F.lit("")), "filingDate"))


def document_table(filings: DataFrame, text: str = "sgml") -> DataFrame:
    """(accession, type, sequence, filename) of each entry of a filing's document table."""
    part = lambda g: F.regexp_extract_all(unescape(F.col(text)), F.lit(DOCUMENT_ENTRY), F.lit(g))
    rows = filings.select("accession", F.explode(F.arrays_zip(part(1).alias("t"), part(2).alias("s"), part(3).alias("f"))).alias("z"))
    return rows.select("accession", F.trim("z.t").alias("type"), F.col("z.s").cast("int").alias("sequence"), F.trim("z.f").alias("filename"))


def choose_exhibit(entries: DataFrame, order: list[str] = EXHIBITS) -> DataFrame:
    """The entry of each filing with the most preferred type (case does not count), ties to the lowest sequence."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.upper("type"))
    w = Window.partitionBy("accession").orderBy("rank", "sequence", "filename")
    return entries.withColumn("rank", rank).where("rank > 0").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "rank")


def press_releases(chosen: DataFrame, text: str = "text", least: int = 500, most: int = 70_000) -> DataFrame:
    """Chosen exhibits with their plain text: those under `least` characters go, longer ones are cut at `most`."""
    return chosen.where(F.length(text) >= least).withColumn(text, F.left(text, F.lit(most)))


def ticker_map(landed: DataFrame) -> DataFrame:
    """(ticker, cik, title) of landed JSON maps, place -> {cik_str, ticker, title}; of a ticker that repeats the last entry of the last
    file wins. landed: file, value."""
    entries = landed.select("file", F.posexplode(F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("at", "e"))
    return entries.groupBy(F.col("e.ticker").alias("ticker")).agg(F.max_by(F.struct("e.cik_str", "e.title"), F.struct("file", "at")).alias("e")).where("ticker is not null").select("ticker", F.col("e.cik_str").alias("cik"), "e.title")


#: Columns of a block of filings, and of a landed history of filings with the shards that hold its older part.
FILING_ARRAYS = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "items", "primaryDocument"]
FILING_BLOCK = "struct<" + ", ".join(f"{a}: array<string>" for a in FILING_ARRAYS) + ">"
HISTORY = f"struct<filings: struct<recent: {FILING_BLOCK}, files: array<struct<name: string>>>>"


def submissions(histories: DataFrame, shards: DataFrame) -> DataFrame:
    """Filing rows of every history: of its recent block and of each shard that it names. histories: ticker, cik, value (JSON text);
    shards: name, value. Shards that have not landed are told by missing_shards."""
    read = histories.select("ticker", "cik", F.from_json("value", HISTORY)["filings"].alias("f"))
    old = read.select("ticker", "cik", F.explode("f.files.name").alias("name")).join(shards, "name").select("ticker", "cik", F.from_json("value", FILING_BLOCK).alias("b"))
    return filing_rows(read.select("ticker", "cik", F.col("f.recent").alias("b")).unionByName(old).select("ticker", "cik", "b.*"), FILING_ARRAYS)


def missing_shards(histories: DataFrame, shards: DataFrame) -> DataFrame:
    """Names of shards that histories list and that have not landed."""
    return histories.select(F.explode(F.from_json("value", HISTORY)["filings"]["files"]["name"]).alias("name")).distinct().join(shards, "name", "left_anti")


def wanted_symbols(tickers: DataFrame, market: str = "SPY") -> DataFrame:
    """The tickers and the market's symbol, each once."""
    return tickers.select("ticker").union(tickers.sparkSession.createDataFrame([(market,)], "ticker string")).distinct()


def missing_symbols(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Symbols without a price."""
    return wanted.select("ticker").distinct().join(prices.select("ticker").distinct(), "ticker", "left_anti")


def with_documents(filings: DataFrame, documents: DataFrame) -> DataFrame:
    """Filings whose document has landed, with its text."""
    return filings.join(documents, "accession")


def tolerant_json(landed: DataFrame, schema: str) -> DataFrame:
    """(file, data) of landed JSON texts; data is null where a text is empty, broken or missing."""
    return landed.select("file", F.try_parse_json("value").isNotNull().alias("fine"), F.from_json("value", schema).alias("d")).select("file", F.expr("case when fine then d end").alias("data"))


def read_settings(text: str) -> dict:
    """A configuration of nested maps and lists of scalars or flow maps, in the part of YAML that such files use. Driver side."""
    import json
    import re

    def scalar(x: str):
        x = x.strip()
        if x[:1] in "\"'" and x[:1]:
            return x[1:-1]
        if x.startswith("{") or x.startswith("["):
            inner = [p.strip() for p in re.split(r",(?![^\[{]*[\]}])", x[1:-1]) if p.strip()]
            return [scalar(p) for p in inner] if x[0] == "[" else {k.strip(): scalar(v) for k, v in (p.split(":", 1) for p in inner)}
        if x in ("", "~", "null"):
            return None
        try:
            return json.loads(x.lower() if x.lower() in ("true", "false") else x)
        except ValueError:
            return x

    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(i: int, indent: int):
        out = None
        while i < len(lines) and lines[i][0] == indent and (out is None or isinstance(out, list) == lines[i][1].startswith("- ")):
            line = lines[i][1]
            if line.startswith("- "):
                out = [] if out is None else out
                rest = line[2:].strip()
                if re.match(r"[\w.-]+:(\s|$)", rest):
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
            else:
                out = {} if out is None else out
                name, rest = line.split(":", 1)
                i += 1
                if rest.strip():
                    out[name.strip()] = scalar(rest)
                elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("- ")):
                    out[name.strip()], i = block(i, lines[i][0])
                else:
                    out[name.strip()] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def as_map(wide: DataFrame, name: str, key: str = "date") -> DataFrame:
    """(key, name): a wide table's other columns as one map from their names to doubles; the plan doesn't grow with the columns."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide.columns if c != key]))
    return wide.select(F.to_date(key).alias(key), F.from_json(cells, "map<string,double>").alias(name))


def tidy_maps(close: DataFrame, volume: DataFrame) -> DataFrame:
    """(date, ticker, close, volume) from a row for each date with a map of closes and one of volumes, by ticker, that meet by date. Cells
    without a close are dropped, a missing volume is null; of rows that repeat a date all cells are given."""
    both = close.join(volume, "date", "left")
    cells = F.map_zip_with("close", F.coalesce("volume", F.create_map().cast("map<string,double>")), lambda k, c, v: F.struct(c.alias("close"), v.alias("volume")))
    return both.select("date", F.explode(cells).alias("ticker", "cell")).select("date", "ticker", "cell.*").where("close is not null")


def tidy_prices(close: DataFrame, volume: DataFrame, tickers: list[str]) -> DataFrame:
    """(date, ticker, close, volume) from wide tables with a column for each ticker; rows without a close are dropped, a missing volume is null."""
    only = lambda df, name: as_map(df.select("date", *[F.col(f"`{t}`") for t in tickers]), name)
    return tidy_maps(only(close, "close"), only(volume, "volume"))


def universe(tickers: DataFrame, ciks: DataFrame, counts: DataFrame, least: int = 8) -> DataFrame:
    """tickers with cik, n_filings and skip_reason: 'no CIK', 'only n', or null for those that stay."""
    out = tickers.join(ciks, "ticker", "left").join(counts, "ticker", "left").withColumn("n_filings", F.coalesce("n_filings", F.lit(0)))
    return out.withColumn("skip_reason", F.when(F.col("cik").isNull(), "no CIK").when(F.col("n_filings") < least, F.concat(F.lit("only "), F.col("n_filings").cast("string"))))


def first_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first in a stated order."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r = 1").drop("r")
