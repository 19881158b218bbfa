"""Prospects: matching the company register with known customers, scoring, searching."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions.calendar import months_before
from retailoom.functions.numbers import percent
from retailoom.functions import keywords
from retailoom.functions.text import any_contains, digits_only_key, keyword_tags, normalize_name
from retailoom.operators.lists import as_value
from retailoom.sources.tables import Stages, staged

_REGISTER = (
    "siret", "siren", "nic", "denomination", "adresse_voie", "adresse_complement", "zip_code",
    "city", "dept_code", "insee_code", "date_creation", "tranche_effectif_code",
    "tranche_effectif_libelle", "naf_code", "etat_admin", "categorie_juridique", "forme_juridique",
)


def known_clients(detail: DataFrame) -> DataFrame:
    """Merged customers in France with their comparable number, name and zip."""
    return detail.where((F.col("boutique_id") == fixed.MERGED_SHOP) & F.col("is_france")).select(
        F.col("customer_key").alias("client_key"),
        digits_only_key("siren").alias("client_siren"),
        normalize_name(F.coalesce("customer_name", F.lit(""))).alias("client_name"),
        F.col("zip_code").alias("client_zip"),
    )


def client_keys(detail: DataFrame) -> DataFrame:
    """Smallest customer per company number (kind n) and per name and zip (kind z)."""
    clients = known_clients(detail)
    both = clients.select("client_key", F.inline(F.array(
        F.struct(F.lit("n").alias("kind"), F.col("client_siren").alias("key"), F.lit("").alias("zip")),
        F.struct(F.lit("z").alias("kind"), F.nullif(F.col("client_name"), F.lit("")).alias("key"), F.col("client_zip").alias("zip")))))
    usable = both.where(F.col("key").isNotNull() & F.col("zip").isNotNull())
    return usable.groupBy("kind", "key", "zip").agg(F.min("client_key").alias("client_key"))


def match_prospects(reg: DataFrame, detail: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Match each establishment to at most one customer: by company number, else by
    normalised name and zip.

    The customer side is computed once and written, with one row per join key (the smallest
    customer key), so a company with many customers cannot multiply establishments. Rows
    that cannot match carry their own siret as a probe value and spread over the join
    instead of piling up in the NULL partition.
    """
    keys = staged(client_keys(detail), stages)
    by_number = keys.where("kind = 'n'").select(F.col("key").alias("_n"), F.col("client_key").alias("_m2"))
    by_name = keys.where("kind = 'z'").select(F.col("key").alias("_name"), F.col("zip").alias("_zip"), F.col("client_key").alias("_m3"))
    own = F.concat(F.lit("?"), F.col("siret"))
    probe = F.when(F.col("denomination_normalized") != "", F.col("denomination_normalized"))
    return (
        reg.withColumn("_pn", F.coalesce(digits_only_key("siren"), own))
        .withColumn("_pname", F.coalesce(probe, own))
        .join(by_number, F.col("_pn") == F.col("_n"), "left")
        .join(by_name, (F.col("_pname") == F.col("_name")) & (F.col("zip_code") == F.col("_zip")), "left")
        .withColumn("matched_unified_key", F.coalesce("_m2", "_m3"))
        .withColumn(
            "match_rule",
            F.when(F.col("_m2").isNotNull(), F.lit("M2_SIREN")).when(F.col("_m3").isNotNull(), F.lit("M3_NOM_CP")),
        )
        .withColumn("is_prospect", F.col("match_rule").isNull())
        .drop("_pn", "_pname", "_n", "_m2", "_name", "_zip", "_m3")
    )


def chain_flag(c, chains: "Sequence[str] | DataFrame") -> Column:
    """True when the name contains a known chain as whole words.

    ``chains`` is a list of patterns or a table with a ``pattern`` column (read once; its size is
    bounded by ``keywords.MAX_ALTERNATIVES``). The name's tokens meet the patterns' anchors in
    one pass, and only the patterns found are tried.
    """
    if isinstance(chains, DataFrame):
        rows = chains.select("pattern").where(F.col("pattern").isNotNull()).limit(keywords.MAX_ALTERNATIVES + 1).collect()
        chains = [r.pattern for r in rows]
    patterns = [p for p in chains if p]
    if not patterns:
        return F.lit(False)
    return keywords.any_match(c, patterns, whole_word=True)


def usable_name(c="denomination") -> Column:
    name = F.trim(F.col(c))
    return F.coalesce(~name.isin(*fixed.UNUSABLE_NAMES), F.lit(False))


def prospect_score(as_of: date) -> Column:
    """0 to 100: employees 30, older than two years 20, company 30, usable name 20."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (
        points(~F.col("tranche_effectif_code").isin(*fixed.NO_HEADCOUNT), 30)
        + points(F.col("date_creation") < F.lit(months_before(as_of, 24)), 20)
        + points(F.col("forme_juridique") == "societe", 30)
        + points(usable_name(), 20)
    ).cast("bigint")


def prospects(reg: DataFrame, detail: DataFrame, chains: Sequence[str], as_of: date, stages: Stages | None = None) -> DataFrame:
    """Register with match, shop tags, chain flag and score."""
    return match_prospects(reg, detail, stages).select(
        *_REGISTER,
        "matched_unified_key",
        "match_rule",
        "is_prospect",
        keyword_tags("denomination").alias("shop_type_tags"),
        chain_flag("denomination", chains).alias("is_chain"),
        prospect_score(as_of).alias("score_prospect"),
    )


def prospects_by_dept(mart: DataFrame, seed: DataFrame) -> DataFrame:
    """Establishments, customers and net prospects per department."""
    names = seed.select("dept_code", F.col("dept_name").alias("_name"))
    return (
        mart.where(F.col("dept_code").isNotNull())
        .groupBy("dept_code")
        .agg(
            F.count("*").alias("nb_sirene_total"),
            F.count_if(~F.col("is_prospect")).alias("nb_clients"),
            F.count_if("is_prospect").alias("nb_prospects_nets"),
            F.count_if(F.col("match_rule") == "M3_NOM_CP").alias("nb_matches_incertains"),
        )
        .join(names, "dept_code", "left")
        .select(
            F.col("dept_code").alias("code_departement"),
            F.coalesce("_name", "dept_code").alias("nom_departement"),
            "nb_sirene_total", "nb_clients", "nb_prospects_nets", "nb_matches_incertains",
            percent("nb_clients", "nb_sirene_total").alias("taux_penetration_pct"),
        )
    )


def prospect_totals(by_dept: DataFrame) -> DataFrame:
    """National totals and penetration."""
    counts = ("nb_sirene_total", "nb_clients", "nb_prospects_nets", "nb_matches_incertains")
    return by_dept.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).withColumn(
        "taux_penetration_pct", percent("nb_clients", "nb_sirene_total")
    )


def uncertain_matches(mart: DataFrame, detail: DataFrame) -> DataFrame:
    """Name and zip matches with the customer they hit, for review by a person."""
    merged = detail.where(F.col("boutique_id") == fixed.MERGED_SHOP).select(
        F.col("customer_key").alias("matched_unified_key"),
        F.col("customer_name").alias("matched_client_name"),
        F.col("zip_code").alias("matched_client_zip"),
    )
    return (
        mart.where(F.col("match_rule") == "M3_NOM_CP")
        .select("siret", "denomination", "zip_code", "city", "dept_code", "matched_unified_key")
        .join(merged, "matched_unified_key", "left")
        .select(
            "siret", "denomination", "zip_code", "city", "dept_code", "matched_unified_key",
            "matched_client_name", "matched_client_zip", F.lit(1.0).alias("similarity_score"),
        )
    )


# --- Search -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ProspectFilter:
    """Optional conditions of the prospect search; the defaults hide chains and rows
    without a usable name."""

    dept: str | None = None
    statuses: list[str] = field(default_factory=list)
    headcounts: list[str] = field(default_factory=list)
    text: str | None = None
    zip_prefix: str | None = None
    created_from: date | None = None
    created_to: date | None = None
    regions: list[str] = field(default_factory=list)
    named_only: bool = True
    shop_types: list[str] = field(default_factory=list)
    include_chains: bool = False
    legal_forms: list[str] = field(default_factory=list)
    min_score: int = 0

    def __post_init__(self):
        for values, allowed, what in (
            (self.statuses, set(fixed.PROSPECT_STATUSES), "status"),
            (self.shop_types, {t for t, _ in fixed.SHOP_TAG_RULES} | {fixed.UNTAGGED}, "shop type"),
            (self.legal_forms, set(fixed.LEGAL_BUCKETS), "legal form"),
        ):
            unknown = [v for v in values if v not in allowed]
            if unknown:
                raise ValueError(f"unknown {what}: {unknown}")

    def on_prospects(self) -> list[Column]:
        """Conditions on register columns, usable before any join."""
        out = [F.col("is_prospect")]
        if self.dept:
            out.append(F.col("dept_code") == self.dept)
        if self.headcounts:
            out.append(F.col("tranche_effectif_code").isin(*self.headcounts))
        if self.text:
            out.append(any_contains(["denomination", "siret", "city"], self.text))
        digits = "".join(ch for ch in self.zip_prefix or "" if ch.isdigit())
        if digits:
            out.append(F.col("zip_code").startswith(digits))
        if self.created_from:
            out.append(F.col("date_creation") >= F.lit(self.created_from))
        if self.created_to:
            out.append(F.col("date_creation") <= F.lit(self.created_to))
        if self.named_only:
            out.append(usable_name())
        if self.shop_types:
            tags = [t for t in self.shop_types if t != fixed.UNTAGGED]
            wanted = []
            if tags:
                wanted.append(F.arrays_overlap("shop_type_tags", F.array(*[F.lit(t) for t in tags])))
            if fixed.UNTAGGED in self.shop_types:
                wanted.append(F.size("shop_type_tags") == 0)
            out.append(reduce(lambda a, b: a | b, wanted))
        if not self.include_chains:
            out.append(~F.col("is_chain"))
        if self.legal_forms:
            out.append(F.col("forme_juridique").isin(*self.legal_forms))
        if self.min_score > 0:
            out.append(F.col("score_prospect") >= self.min_score)
        return out


_SEARCH = (
    "siret", "siren", "denomination", "adresse_voie", "adresse_complement", "zip_code", "city",
    "dept_code", "date_creation", "tranche_effectif_code", "tranche_effectif_libelle",
    "etat_admin", "categorie_juridique", "forme_juridique", "score_prospect", "shop_type_tags",
    "is_chain",
)
SORTABLE = (
    "denomination", "zip_code", "dept_code", "date_creation", "statut", "dernier_contact", "score_prospect",
)


def prospect_search(mart: DataFrame, status: DataFrame, seed: DataFrame, wanted: ProspectFilter = ProspectFilter()) -> DataFrame:
    """Prospects that meet the filter, with their contact status (default: to contact)."""
    rows = mart.where(reduce(lambda a, b: a & b, wanted.on_prospects())).select(*_SEARCH)
    if wanted.regions:
        depts = seed.where(F.col("region_name").isin(*wanted.regions)).select("dept_code")
        rows = rows.join(depts, "dept_code", "left_semi")
    edits = status.select("siret", F.col("statut").alias("_s"), "note", "dernier_contact", "updated_at")
    out = rows.join(edits, "siret", "left").select(
        *_SEARCH,
        F.coalesce("_s", F.lit(fixed.PROSPECT_STATUS_DEFAULT)).alias("statut"),
        "note", "dernier_contact", "updated_at",
    )
    if wanted.statuses:
        out = out.where(F.col("statut").isin(*wanted.statuses))
    return out


def prospect_counts(found: DataFrame) -> DataFrame:
    """Total and counts per status of a search result."""
    return found.agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col("statut") == s).alias(f"_nb_{s}") for s in fixed.PROSPECT_STATUSES],
    )


def prospect_page(found: DataFrame, sort: str = "dept_code", direction: str = "asc", limit: int = 50,
                  offset: int = 0, stages: Stages | None = None) -> DataFrame:
    """One page of a search result, each row with the counts of the whole result.

    The result is written once; page and counts read it.
    """
    found = staged(found, stages)
    column = F.col(sort if sort in SORTABLE else "dept_code")
    first = column.desc_nulls_last() if direction == "desc" else column.asc_nulls_first()
    order = [first, F.col("denomination").asc_nulls_first(), F.col("siret").asc()]
    counts = prospect_counts(found)
    rows = found.orderBy(*order).offset(offset).limit(limit)
    return rows.select("*", as_value(counts).alias("_counts")).select(*found.columns, "_counts.*")


def region_options(seed: DataFrame) -> DataFrame:
    return seed.where(F.col("region_name").isNotNull()).select("region_name").distinct().orderBy("region_name")


def headcount_options(mart: DataFrame) -> DataFrame:
    return (
        mart.where(F.col("is_prospect") & F.col("tranche_effectif_code").isNotNull())
        .select(F.col("tranche_effectif_code").alias("code"), F.col("tranche_effectif_libelle").alias("label"))
        .distinct()
        .orderBy("code")
    )


def prospect_options(mart: DataFrame, seed: DataFrame) -> DataFrame:
    """Choices of the search form: regions of the seed and headcounts of the prospects."""
    regions = region_options(seed).select(
        F.lit("region").alias("kind"), F.col("region_name").alias("code"), F.col("region_name").alias("label")
    )
    both = regions.unionByName(headcount_options(mart).select(F.lit("headcount").alias("kind"), "code", "label"))
    return both.orderBy("kind", "code")


# --- Editable status --------------------------------------------------------------------


def check_changes(changes: DataFrame, mart: DataFrame, as_of: date) -> tuple[DataFrame, DataFrame]:
    """(valid changes, rejected changes with a reason)."""
    note_size = F.length("note")
    reason = (
        F.when(F.col("siret").isNull() | ~F.col("siret").rlike(r"^\d{14}$"), F.lit("siret"))
        .when(F.col("statut").isNull() | ~F.col("statut").isin(*fixed.PROSPECT_STATUSES), F.lit("statut"))
        .when(note_size > fixed.NOTE_MAX_CHARS, F.lit("note"))
        .when(F.col("dernier_contact") > F.lit(as_of), F.lit("dernier_contact"))
    )
    checked = changes.withColumn("reason", reason)
    formal = checked.where(F.col("reason").isNull()).drop("reason")
    known = mart.where("is_prospect").select("siret")
    valid = formal.join(known, "siret", "left_semi")
    unknown = formal.join(known, "siret", "left_anti").withColumn("reason", F.lit("unknown siret"))
    return valid, checked.where(F.col("reason").isNotNull()).unionByName(unknown)


def upsert_status(status: DataFrame, changes: DataFrame, mart: DataFrame, as_of: date) -> tuple[DataFrame, DataFrame]:
    """(new status table, rejected changes).

    ``changes`` holds siret, statut, note, dernier_contact and updated_at; the latest change
    of a siret wins. It is found by an aggregate that combines on the map side, so a siret
    edited very often does not end up whole in one task.
    """
    valid, rejects = check_changes(changes, mart, as_of)
    contact = F.when(
        F.col("statut") == fixed.PROSPECT_STATUS_DEFAULT, F.col("dernier_contact")
    ).otherwise(F.coalesce("dernier_contact", F.lit(as_of)))
    by = F.col("updated_by") if "updated_by" in changes.columns else F.lit(None).cast("string")
    row = F.struct("statut", "note", contact.alias("dernier_contact"), "updated_at", by.alias("updated_by"))
    # equal times are decided by the whole edit, so each run keeps the same one
    recency = F.struct("updated_at", "statut", "note", "dernier_contact", by.alias("updated_by"))
    latest = valid.groupBy("siret").agg(F.max_by(row, recency).alias("_r")).select("siret", "_r.*")
    kept = status.join(latest.select("siret"), "siret", "left_anti")
    return kept.select(*latest.columns).unionByName(latest), rejects


def write_status(new_status: DataFrame, root: str, version: str) -> str:
    """Write the status table to a new versioned folder and publish it as the current one.

    The table read while computing the new one is never overwritten in place. Readers go by the
    file ``CURRENT``, which is replaced only after the version is complete.
    """
    spark, root = new_status.sparkSession, root.rstrip("/")
    path = f"{root}/version={version}"
    new_status.write.mode("errorifexists").parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    current, fresh = fs_path(f"{root}/CURRENT"), fs_path(f"{root}/CURRENT.new")
    fs = current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(current, False)
    fs.rename(fresh, current)
    return path


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """The published version of the status table."""
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


def export_prospects_csv(found: DataFrame, path: str) -> None:
    """Whole search result as semicolon CSV with CRLF line ends, by department and name.

    The files are ranges of the order, written in parallel.
    """
    order = [F.col("dept_code").asc_nulls_first(), F.col("denomination").asc_nulls_first(), F.col("siret").asc()]
    columns = []
    for name in fixed.EXPORT_COLUMNS:
        text = F.col(name).cast("string")
        if name == "updated_at":
            text = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        columns.append(F.coalesce(F.regexp_replace(text, r"[\r\n]", " "), F.lit("")).alias(name))
    (
        found.orderBy(*order)
        .select(*columns)
        .write.mode("overwrite")
        .option("sep", ";")
        .option("header", True)
        .option("lineSep", "\r\n")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
