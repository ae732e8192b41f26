"""Feature-set files: dictionary-packed, GMT, and whatever people paste; and writing them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.operators.sets import readable_name

# The packed format's tag, and what a GMT's second column may say instead of a gene.
PACKED_TAG = "MSIG1"
DESCRIPTION = r"(?i)^$|\s|^https?:|^(na|n/a|none|null|-|\.|\?)$"


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Members of packed files: a header, one line of symbols, then id, name and comma-joined indices.

    Files whose counts disagree with their header are refused.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.split("value", "\n").alias("l"))
    head = F.split(F.col("l")[0], "\t")
    sets = F.filter(F.slice("l", 3, F.greatest(F.size("l"), F.lit(3))), lambda s: s != "")
    opened = lines.select(
        head.alias("head"), F.split(F.col("l")[1], "\t").alias("symbols"), sets.alias("sets"))
    sound = ((F.col("head")[0] == PACKED_TAG) & (F.size("symbols") == F.col("head")[5].cast("int"))
             & (F.size("sets") == F.col("head")[4].cast("int")))
    checked = opened.withColumn("sets", F.when(sound, F.col("sets")).otherwise(
        F.raise_error(F.lit("feature-set file does not match its header")).cast("array<string>")))
    # The dictionary of each file is a table of its own; a member is a join with it.
    file = F.monotonically_increasing_id()
    opened = checked.withColumn("file", file)
    symbols = opened.select("file", F.posexplode("symbols").alias("at", "gene"))
    rows = opened.select("file", "head", F.explode("sets").alias("s")).select(
        "file", F.col("head")[1].alias("species"), F.col("head")[2].alias("source"), F.col("head")[3].alias("release"),
        F.split("s", "\t").alias("f"))
    rows = rows.select(
        "file", "species", "source", "release", F.col("f")[0].alias("set_id"), F.col("f")[1].alias("set_name"),
        F.posexplode(F.split(F.col("f")[2], ",")).alias("pos", "at"))
    return rows.withColumn("at", F.col("at").cast("int")).join(symbols, ["file", "at"]).select(
        "species", "source", "release", "set_id", "set_name", "gene", F.col("pos").cast("long").alias("pos"))


def pack(members: DataFrame, species: str, release: str) -> DataFrame:
    """value: one packed text per source, from members(source, set_id, set_name, gene, pos)."""
    number = (F.row_number().over(Window.partitionBy("source").orderBy("gene")) - 1).cast("string")
    symbols = members.select("source", "gene").distinct().withColumn("place", number)
    sets = members.join(symbols, ["source", "gene"]).groupBy("source", "set_id", "set_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda s: s["place"]), ",").alias("places"))
    lines = sets.groupBy("source").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "set_id", "set_name", "places"))).alias("l"))
    names = symbols.groupBy("source").agg(F.array_sort(F.collect_list("gene")).alias("symbols"))
    return lines.join(names, "source").select(
        F.concat_ws("\n", F.concat_ws("\t", F.lit(PACKED_TAG), F.lit(species), "source", F.lit(release),
                                      F.size("l").cast("string"), F.size("symbols").cast("string")),
                    F.array_join("symbols", "\t"), F.array_join("l", "\n")).alias("value"))


def read_gmt(spark: SparkSession, path: str, drop_second: bool = True) -> DataFrame:
    """set_id, set_name, gene, pos of tab-separated set files.

    A library build always drops column two; an ad-hoc file keeps it unless it reads
    like a description.
    """
    f = F.split(F.rtrim("value"), "\t")
    rows = spark.read.text(path).where(F.rtrim("value") != "").select(f.alias("f")).where(
        F.size("f") >= (3 if drop_second else 2))
    rest = lambda k: F.slice("f", k, F.greatest(F.size("f") - (k - 1), F.lit(0)))
    described = (F.size("f") >= 3) & F.trim(F.col("f")[1]).rlike(DESCRIPTION)
    genes = rest(3) if drop_second else F.when(described, rest(3)).otherwise(rest(2))
    name = readable_name(F.col("f")[0]) if drop_second else F.col("f")[0]
    return rows.select(F.col("f")[0].alias("set_id"), name.alias("set_name"), F.posexplode(genes).alias("pos", "gene")).where(
        F.col("gene") != "")


def sets_to_text(members: DataFrame) -> DataFrame:
    """value: one ``Name: a, b`` line per set."""
    genes = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda s: s["gene"]), ", ")
    return members.groupBy("set_id", "set_name").agg(genes.alias("genes")).select(
        F.concat_ws(": ", "set_name", "genes").alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """species, release, source, file, n_sets, n_genes, on: one row per collection on offer."""
    entry = "array<struct<source:string,file:string,nSets:bigint,nGenes:bigint,on:boolean,projected:boolean>>"
    raw = spark.read.schema(
        f"species map<string,struct<label:string,release:string,sources:{entry}>>").json(path, multiLine=True)
    return raw.select(F.explode("species").alias("species", "s")).select(
        "species", "s.release", F.posexplode("s.sources").alias("source_pos", "e")).select(
        "species", "release", "source_pos", "e.source", "e.file", F.col("e.nSets").alias("n_sets"),
        F.col("e.nGenes").alias("n_genes"), F.col("e.on").alias("on"))


# ---- sets as people write them, one text per row ----

# Keys that a record carries its name and its members under, in any case.
NAME_KEYS = ["name", "id", "set", "pathway", "term", "geneset", "gene_set", "label"]
GENE_KEYS = ["genes", "members", "symbols", "gene_symbols", "genesymbols", "ids", "list"]


def json_sets(texts: DataFrame) -> DataFrame:
    """path, pos, set_name, genes of texts(path, value) in JSON: an object of lists, an object of records
    with a list each, or a list of records with a name and a list. A record without a name is ``set``
    and its number. Members that are objects, lists or null are left out; so is what has no list.

    Values are read as VARIANT, whose type decides the rule; keys keep the order of the text.
    """
    kind = lambda v: F.schema_of_variant(v)
    record = lambda text: F.from_json(text, "map<string,variant>")

    def members(v: Column) -> Column:
        plain = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: ~kind(x).rlike("^(ARRAY|OBJECT|VOID)"))
        return F.transform(plain, lambda x: F.regexp_replace(
            F.trim(F.try_variant_get(x, "$", "string")), r"^['\"]|['\"]$", ""))

    def first_of(fields: Column, keys: list[str]) -> Column:
        return F.try_element_at(F.map_values(F.map_filter(fields, lambda k, _: F.lower(k).isin(keys))), F.lit(1))

    # Objects: the member list itself, or a record that carries one. Both maps have the keys of the text, in its order.
    fields = F.arrays_zip(
        F.map_keys(F.col("texts")).alias("name"), F.map_values(F.col("texts")).alias("text"), F.map_values(F.col("typed")).alias("own"))
    opens = lambda c: F.ltrim("value").startswith(c)
    entry = texts.where(opens("{")).select(
        "path", F.from_json("value", "map<string,string>").alias("texts"), record(F.col("value")).alias("typed")).select(
        "path", F.posexplode(fields).alias("pos", "e")).select(
        "path", "pos", F.col("e.name").alias("set_name"), F.col("e.text").alias("text"), F.col("e.own").alias("own"))
    inner = F.when(kind(F.col("own")).startswith("OBJECT"), first_of(record(F.col("text")), GENE_KEYS))
    found = F.when(kind(F.col("own")).startswith("ARRAY"), F.col("own")).otherwise(inner)
    named = entry.select("path", "pos", "set_name", members(found).alias("genes"))
    # Lists of records.
    each = texts.where(opens("[")).select(
        "path", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "text"))
    each = each.withColumn("fields", record(F.col("text"))).select(
        "path", "pos", F.try_variant_get(first_of(F.col("fields"), NAME_KEYS), "$", "string").alias("set_name"),
        members(first_of(F.col("fields"), GENE_KEYS)).alias("genes")).where(F.size("genes") > 0)
    # The records of one text are numbered; a text is one row, so they fit a task.
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    each = each.withColumn("set_name", F.coalesce("set_name", F.concat(F.lit("set "), number.cast("string"))))
    return named.unionByName(each).where((F.size("genes") > 0) & F.trim("set_name").rlike("[A-Za-z0-9]"))


def parse_sets(texts: DataFrame) -> DataFrame:
    """path, set_name, genes, pos of texts(path, value). A text is JSON in one of its three shapes, or lines of
    tab-separated fields (a description in the second is dropped) or of ``Name: a, b``; any other line
    adds to one set named by the path. The last of several sets of one name wins."""
    is_json = F.ltrim("value").rlike(r"^[{\[]")
    listed = json_sets(texts.where(is_json))
    line = texts.where(~is_json).select("path", F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "line")).where(
        F.trim("line") != "")
    tabs = F.split("line", "\t")
    described = (F.size(tabs) > 2) & F.trim(tabs[1]).rlike(DESCRIPTION)
    fields = F.slice(tabs, F.when(described, 3).otherwise(2), F.size(tabs))
    colon = F.instr("line", ":")
    words = lambda text: F.split(text, r"[,;\s]+")
    rows = line.select(
        "path", "pos",
        F.when(F.size(tabs) > 1, tabs[0]).when(colon > 1, F.substring_index("line", ":", 1)).alias("set_name"),
        F.when(F.size(tabs) > 1, fields).when(colon > 1, words(F.expr("substring(line, instr(line, ':') + 1)")))
        .otherwise(words(F.col("line"))).alias("genes"))
    bare = rows.where("set_name IS NULL").groupBy("path").agg(
        F.min("pos").alias("pos"), F.flatten(F.array_sort(F.collect_list(F.struct("pos", "genes")))["genes"]).alias("genes"))
    found = listed.unionByName(rows.where("set_name IS NOT NULL")).unionByName(bare.withColumn("set_name", F.col("path")))
    clean = F.array_distinct(F.filter(F.transform("genes", lambda g: F.trim(g)), lambda g: g != ""))
    found = found.withColumns({"genes": clean, "set_name": F.trim("set_name")}).where(F.size("genes") > 0)
    return found.groupBy("path", "set_name").agg(F.max_by("genes", "pos").alias("genes"), F.min("pos").alias("pos"))
