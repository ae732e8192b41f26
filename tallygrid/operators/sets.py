"""Feature-set libraries as a long table: source, source_pos, set_id, set_name, gene, pos."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.plans.ordering import numbered

# Offered set sizes. A library whose every collection is small starts at 3.
SIZE_MIN, SIZE_MIN_SMALL, SIZE_MAX, SMALL_LIBRARY = 10, 3, 500, 200


def symbols(df: DataFrame, column: str = "gene") -> DataFrame:
    """Distinct upper-cased names: u."""
    return df.select(F.upper(F.col(column)).alias("u")).distinct()


def enabled(members: DataFrame, sources: list[str], custom: DataFrame | None = None) -> DataFrame:
    """Members of the enabled collections; custom sets stay whatever is switched off."""
    kept = members.where(F.col("source").isin(sources))
    return kept if custom is None else kept.unionByName(custom)


def first_collection(members: DataFrame) -> DataFrame:
    """One id, one test: the first collection carrying a set id keeps it."""
    owner = members.groupBy("set_id").agg(F.min("source_pos").alias("source_pos"))
    return members.join(owner, ["set_id", "source_pos"], "left_semi")


def annotated_background(background: DataFrame, members: DataFrame) -> DataFrame:
    """Background names that at least one set given mentions."""
    return symbols(background).join(symbols(members), "u", "left_semi")


def folded_members(members: DataFrame, background: DataFrame) -> DataFrame:
    """Distinct (set, symbol) rows inside the background, each set id under its first collection."""
    mine = first_collection(members).select(
        "source", "set_id", "set_name", F.upper("gene").alias("u")).distinct()
    return mine.join(symbols(background), "u", "left_semi")


def minimum_size(members: DataFrame) -> int:
    """Lower size bound offered at start: 3 when every collection is small, else 10."""
    sizes = members.groupBy("source").agg(F.count_distinct("set_id").alias("n")).agg(F.max("n")).first()[0]
    return SIZE_MIN_SMALL if sizes is not None and sizes < SMALL_LIBRARY else SIZE_MIN


def in_window(index: DataFrame, min_size: int, max_size: int) -> DataFrame:
    return index.agg(F.count_if(F.col("set_size").between(min_size, max_size)).alias("in_window"),
                     F.count(F.lit(1)).alias("sets"))


def library_coverage(members: DataFrame, background: DataFrame) -> DataFrame:
    """How many library symbols the object measures, and how many of its genes are annotated."""
    lib = symbols(members).withColumn("lib", F.lit(True))
    return lib.join(symbols(background).withColumn("bg", F.lit(True)), "u", "full").agg(
        F.count("lib").alias("library"), F.count("bg").alias("measured"),
        F.count_if(F.col("lib") & F.col("bg")).alias("annotated"))


def set_coverage(members: DataFrame, genes: DataFrame) -> DataFrame:
    """Per set: members found in the object and members missing, case aside."""
    mine = members.select("source", "set_id", F.lower("gene").alias("l")).distinct()
    have = genes.select(F.lower("gene").alias("l"), F.lit(True).alias("have")).distinct()
    return mine.join(have, "l", "left").groupBy("source", "set_id").agg(
        F.count("have").alias("found"), F.count_if(F.col("have").isNull()).alias("missing"))


def find_sets(members: DataFrame, words: str, limit: int = 40) -> DataFrame:
    """Sets whose name and id contain every word typed."""
    sets = members.select("source", "source_pos", "set_id", "set_name").distinct()
    hay = F.lower(F.concat_ws(" ", "set_name", "set_id"))
    for word in words.lower().split():
        sets = sets.where(hay.contains(word))
    return sets.orderBy("source_pos", "set_id").limit(limit)


def keep_last(sets: DataFrame) -> DataFrame:
    """A repeated set name replaces: set_name, genes, pos -> the genes of the last occurrence."""
    return sets.groupBy("set_name").agg(F.max_by("genes", "pos").alias("genes"), F.min("pos").alias("pos"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key, by a running minimum rather than a sort."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


# ---- deriving a collection from a curated term list ----

# The words that make a set name look metabolic.
LOOKS_METABOLIC = (
    "METABOL|CATABOL|BIOSYNTH|GLYCOLY|GLUCONEOGEN|TCA_CYCLE|CITRIC_ACID|"
    "OXIDATIVE_PHOSPHORYL|ELECTRON_TRANSPORT|RESPIRATION|PENTOSE_PHOSPHATE|"
    "GLYCOGEN|GLUCOSE|FATTY_ACID|BETA_OXIDATION|LIPID|CHOLESTEROL|STEROL|"
    "BILE_ACID|KETONE|UREA_CYCLE|AMINO_ACID|NUCLEOTIDE|PURINE|PYRIMIDINE|"
    "FOLATE|GLUTATHIONE|PEROXISOM|MITOCHONDRIAL_RESPIR|ATP_SYNTH"
)


def origin(source: Column) -> Column:
    """A collection's label as it reads inside a name's brackets: no brackets of its own."""
    return F.trim(F.regexp_replace(F.regexp_replace(source, "[()]", ""), r"\s+", " "))


def derive(members: DataFrame, terms: DataFrame, prefix: str, label: str) -> DataFrame:
    """Listed sets of several collections as one: ids prefixed, names carrying their origin."""
    listed = first_collection(members).join(terms.where("keep").select("set_id"), "set_id", "left_semi")
    return listed.select(
        F.lit(label).alias("source"), F.lit(0).alias("source_pos"),
        F.concat(F.lit(prefix), "set_id").alias("set_id"),
        F.concat(F.col("set_name"), F.lit(" ("), origin(F.col("source")), F.lit(")")).alias("set_name"),
        "gene", "pos",
    )


def stale_terms(members: DataFrame, terms: DataFrame) -> DataFrame:
    """Listed ids that no collection offers any more."""
    return terms.select("set_id").distinct().join(members, "set_id", "left_anti")


def unjudged_terms(members: DataFrame, terms: DataFrame, pattern: str = LOOKS_METABOLIC) -> DataFrame:
    """Offered ids that look relevant and are neither kept nor judged out; the last source offering one is named."""
    alike = members.where(F.col("set_id").rlike(pattern)).join(terms, "set_id", "left_anti")
    return alike.groupBy("set_id").agg(F.max_by("source", "source_pos").alias("source"))


# ---- resolving names ----


def name_index(genes: DataFrame) -> DataFrame:
    """Every lower-cased name a gene answers to: l, gene_id, gene (its display name)."""
    spellings = [F.col(c) for c in ("gene", "bare", "other") if c in genes.columns]
    return genes.select(
        F.explode(F.array_distinct(F.transform(F.array(*spellings), F.lower))).alias("l"),
        "gene_id", "gene").where("l IS NOT NULL")


def resolve(words: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for words(pos, word): found genes once, by first position; one word may name several."""
    # Spellings and repeats of a word are one row before the join: a name that many genes share and many
    # words ask for would otherwise meet as often as the product of the two.
    asked = words.groupBy("word", F.lower(F.trim("word")).alias("l")).agg(F.min("pos").alias("pos"))
    index = name_index(genes)
    hits = asked.groupBy("l").agg(F.min("pos").alias("pos")).join(index, "l").groupBy("gene").agg(
        F.min(F.struct("pos", "gene_id")).alias("at"))
    found = hits.select(F.col("at.pos").alias("pos"), F.col("at.gene_id").alias("gene_id"), "gene")
    missing = asked.join(index, "l", "left_anti").select("word", "pos")
    return found, missing


def lookup(words: DataFrame, genes: DataFrame) -> DataFrame:
    """Exact name first, else the first gene whose name matches case aside."""
    exact = genes.select(F.col("gene").alias("word"), F.col("gene").alias("_exact"))
    fold = genes.groupBy(F.lower("gene").alias("l")).agg(F.min_by("gene", "gene_id").alias("_fold"))
    return (
        words.withColumn("l", F.lower("word")).join(exact, "word", "left").join(fold, "l", "left")
        .select("word", F.coalesce("_exact", "_fold").alias("gene"))
    )


# What may stand between two pasted names.
LIST_SEPARATORS = r"[\s,;|]+"


def pasted_words(texts: DataFrame, column: str = "text", key: str | None = None) -> DataFrame:
    """Words of a pasted list with their positions; the first spelling of a repeat counts."""
    words = texts.select(*([key] if key else []), F.posexplode(F.split(column, LIST_SEPARATORS)).alias("pos", "word"))
    return words.where(F.col("word") != "")


def rank_genes(genes: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Autocomplete: exact, then prefix, then substring over any name; shorter first, then by name."""
    q = query.strip().lower()
    if not q:
        return genes.select("gene", F.lit(0).alias("band")).limit(0)

    def band(name: str) -> Column:
        low = F.lower(name)
        return (F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2).otherwise(3))

    best = [band(c) for c in ("gene", "bare", "other") if c in genes.columns]
    score = F.least(*best) if len(best) > 1 else best[0]
    return (genes.select("gene", score.alias("band")).where("band < 3")
            .orderBy("band", F.length("gene"), "gene").limit(limit))


def merge_genes(current: DataFrame, add: DataFrame, keep: int = 100) -> DataFrame:
    """Most recent ``keep`` genes of a selection: (pos, gene) pairs, first occurrence kept."""
    both = current.select(F.lit(0).alias("turn"), "pos", "gene").unionByName(
        add.select(F.lit(1).alias("turn"), "pos", "gene"))
    first = both.groupBy("gene").agg(F.min(F.struct("turn", "pos")).alias("at"))
    last = first.orderBy(F.col("at").desc(), F.col("gene").desc()).limit(keep)
    return last.select("gene", F.col("at.turn").alias("turn"), F.col("at.pos").alias("pos"))


def gene_names(genes: DataFrame) -> DataFrame:
    """Unique display names: gene_id, id, alias (symbol) -> display, bare, other.

    A symbol shared by several rows gets its accession in brackets; a name still
    shared after that is numbered from the second row on.
    """
    named = genes.withColumn("bare", F.coalesce("alias", "id")).withColumn("other", F.col("id"))
    shared = named.groupBy("bare").agg(F.count(F.lit(1)).alias("_n"))
    bracket = F.when(
        (F.col("_n") > 1) & (F.col("other") != F.col("bare")),
        F.concat(F.col("bare"), F.lit(" ("), F.col("other"), F.lit(")"))).otherwise(F.col("bare"))
    first = named.join(shared, "bare").withColumn("display", bracket)
    again = numbered(first, ["display"], "gene_id", out="_k")
    return again.withColumn("display", F.when(
        F.col("_k") > 0, F.concat_ws(" #", "display", (F.col("_k") + 1).cast("string"))).otherwise(
        F.col("display"))).select("gene_id", "id", "alias", "display", "bare", "other")


def readable_name(set_id: Column) -> Column:
    """A systematic set id as words: database prefix off, lower case, first letter raised."""
    # The database prefixes.
    prefix = r"^(HALLMARK|GOBP|GOMF|GOCC|KEGG_MEDICUS|KEGG|REACTOME|WP|BIOCARTA|HP|MODULE)_"
    words = F.lower(F.regexp_replace(F.regexp_replace(set_id, prefix, ""), "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def safe_name(name: str) -> str:
    """A header or entry name that survives a file system: at most 40 safe characters."""
    return re.sub(r"_+", "_", re.sub(r"[^\w.-]", "_", name)).strip("_")[:40] or "x"


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(
        pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


# ---- species ----


def detect_species(genes: DataFrame, name: str = "gene", accession: str | None = None) -> DataFrame:
    """One row: human or mouse, what decided it, and the share that agreed. Every name votes.

    The ``accession`` column decides if it holds ten accessions, then the display name's
    own accessions, then the case of the display names.
    """
    n = F.col(name)
    letters = F.regexp_replace(n, "[^A-Za-z]", "")
    speaks = n.rlike("[A-Za-z]{2}") & (letters != "")
    is_upper = speaks & (letters == F.upper(letters))
    is_title = speaks & (letters != F.upper(letters)) & n.rlike("^[A-Z][a-z]")
    # The accession patterns of the two species.
    mouse, human = r"(?i)^ENSMUS[GTP]\d", r"(?i)^ENS[GTP]\d"
    lists = [accession, name] if accession else [name]
    votes = [c for k, col in enumerate(lists) for c in (
        F.count_if(F.col(col).rlike(mouse)).alias(f"mouse{k}"), F.count_if(F.col(col).rlike(human)).alias(f"human{k}"))]
    v = genes.agg(*votes, F.count_if(is_upper).alias("upper"), F.count_if(is_title).alias("title"))
    cased = F.col("upper") + F.col("title")
    species = F.when(F.col("title") > F.col("upper"), "mouse").otherwise("human")
    said = F.when(cased > 0, "symbols").otherwise("default")
    support = F.when(cased > 0, F.greatest("upper", "title") / cased).otherwise(0.0)
    for k in reversed(range(len(lists))):
        m, h = F.col(f"mouse{k}"), F.col(f"human{k}")
        enough = m + h >= 10
        species = F.when(enough, F.when(m > h, "mouse").otherwise("human")).otherwise(species)
        said = F.when(enough, "accession").otherwise(said)
        support = F.when(enough, F.greatest(m, h) / (m + h)).otherwise(support)
    return v.select(species.alias("species"), said.alias("decided_by"), support.alias("support"))


def match_rate(background: DataFrame, members: DataFrame) -> DataFrame:
    """Share of background names the library spells exactly the same way."""
    lib = members.select("gene").distinct().withColumn("hit", F.lit(True))
    return background.select("gene").join(lib, "gene", "left").agg(
        F.coalesce(F.try_divide(F.count("hit").cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("rate"))
