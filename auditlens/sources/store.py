"""The audit store: three Parquet tables in paise, keyed (tenant, claim_id), and the views over them.

Saves only append. A save writes its claims, findings and gaps into folders of their own, `<table>/version=<n>`, and then one row to
`commits`: until that row is there nobody reads the rest, so a save that dies half way leaves the state before it. A deletion appends
tombstones. A reader takes, of every claim, the rows of its latest committed version. So a save costs what it writes, whatever is stored.

`compact` rewrites the current state as one version, for all tenants or for some; older rows of these are then no longer read, and
`vacuum` deletes their files. Saves compact by size: once the rows appended since the last time come to a share of what was
rewritten then, so that every row is rewritten a few times over its life. One writer at a time; readers need no lock, but a frame that
was read before a vacuum has to be read again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.functions.money import from_paise

KEYS = ["tenant", "claim_id"]
TABLES = ("claims", "findings", "doc_gaps")
#: A save compacts when versions are this many, or when more rows have been appended since the last compaction than this and that
#: share of the rows it wrote.
MAX_VERSIONS, MIN_COMPACT_ROWS, APPENDED_SHARE = 64, 1_000_000, 0.5
#: A vacuum joins the commit rows of dead versions to one file when they are in as many.
MAX_OLD_COMMITS = 64
COMMITS = "version bigint, kind string, batch string, tenants array<string>, n_rows bigint"
SCHEMAS = {
    "claims": ("tenant string, claim_id string, audited_at timestamp, month string, diagnosis string, procedure string, gross_bill_paise bigint, "
               "settlement_paise bigint, patient_liability_paise bigint, hospital_writeoff_paise bigint, room_rent_deduction_paise bigint, "
               "unmapped_count bigint, doc_gap_count bigint, corpus_version string, ai_pipeline boolean"),
    "findings": ("tenant string, claim_id string, line_no bigint, description string, head string, classification string, bearer string, "
                 "amount_paise bigint, deducted_paise bigint, cited_chunk_id string"),
    "doc_gaps": "tenant string, claim_id string, document_id string, name string, severity string",
}
MONEY = {
    "gross_bill": "gross_bill_paise", "settlement": "settlement_paise", "patient_liability": "patient_liability_paise",
    "hospital_writeoff": "hospital_writeoff_paise", "room_rent_deduction": "room_rent_deduction_paise",
    "amount": "amount_paise", "deducted": "deducted_paise",
}


@dataclass(frozen=True)
class Store:
    claims: DataFrame
    findings: DataFrame
    doc_gaps: DataFrame


def store_rows(audit, audited_at: Column | None = None) -> Store:
    """Rows of an audit run in the shape of the store. `audited_at` defaults to the day after discharge,
    so that a re-run writes the same rows; pass current_timestamp() for wall-clock time."""
    stamp = F.to_timestamp(F.date_add("discharge_date", 1)) if audited_at is None else audited_at
    return Store(
        claims=audit.audits.select(
            *KEYS, stamp.alias("audited_at"), "month", "diagnosis", "procedure", F.col("gross_paise").alias("gross_bill_paise"),
            "settlement_paise", F.col("patient_paise").alias("patient_liability_paise"),
            F.col("hospital_paise").alias("hospital_writeoff_paise"), F.col("room_rent_paise").alias("room_rent_deduction_paise"),
            "unmapped_count", "doc_gap_count", "corpus_version", F.col("ai_used").alias("ai_pipeline")),
        findings=audit.findings.select(
            *KEYS, "line_no", "description", "head", "classification", "bearer", "amount_paise", "deducted_paise", "cited_chunk_id"),
        doc_gaps=audit.gaps.select(*KEYS, "document_id", "name", "severity"),
    )


def upsert_rows(existing: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Existing rows without those of the replaced claims, plus the new ones."""
    return existing.join(replaced.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(new)


def orphans(children: DataFrame, claims: DataFrame) -> DataFrame:
    """Child rows whose (tenant, claim_id) has no claim."""
    return children.join(claims.select(*KEYS), KEYS, "left_anti")


# --- files -------------------------------------------------------------------


@dataclass(frozen=True)
class Log:
    """Committed versions, a row each."""

    commits: list[Row]

    @property
    def latest(self) -> int:
        return max((c.version for c in self.commits), default=0)

    @property
    def floor(self) -> int:
        """The last compaction of all tenants; nothing before it is read."""
        return max((c.version for c in self.commits if c.kind == "compact" and c.tenants is None), default=0)

    @property
    def live(self) -> list[Row]:
        return sorted((c for c in self.commits if c.version >= self.floor), key=lambda c: c.version)

    def floors(self) -> dict[str, int]:
        """Tenants that were compacted by themselves since then."""
        return {t: c.version for c in self.live if c.kind == "compact" for t in c.tenants or []}

    def due(self) -> bool:
        rewritten = sum(c.n_rows for c in self.live if c.kind == "compact")
        appended = sum(c.n_rows for c in self.live if c.kind != "compact")
        return len(self.live) >= MAX_VERSIONS or appended > APPENDED_SHARE * rewritten + MIN_COMPACT_ROWS


def _columns(name: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[name].split(", ")]


def _folder(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a folder of the store."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _folder(spark, path)
    fs.delete(target, True)


def read_log(spark: SparkSession, path: str) -> Log:
    fs, commits = _folder(spark, f"{path}/commits")
    if not fs.exists(commits):
        return Log([])
    rows = spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{path}/commits").collect()
    return Log(list({r.version: r for r in rows}.values()))


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the rows of a named batch are in the store, or were."""
    return any(c.batch == batch for c in read_log(spark, path).commits)


def _tenant(spark: SparkSession, folder: str) -> str:
    """The tenant whose rows a folder `tenant=..` holds."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.removeprefix("tenant="))


def _read_versions(spark: SparkSession, path: str, log: Log) -> list[Row]:
    """Live versions with claims of a tenant that was not compacted after them. Those of others hold nothing that is read."""
    floors, found = log.floors(), []
    for c in log.live:
        fs, top = _folder(spark, f"{path}/claims/version={c.version}")
        tenants = [_tenant(spark, f.getPath().getName()) for f in (fs.listStatus(top) if fs.exists(top) else []) if f.isDirectory()]
        if any(c.version >= floors.get(t, 0) for t in tenants):
            found.append(c)
    return found


def _versions(spark: SparkSession, path: str, name: str, log: Log, versions: list[Row]) -> DataFrame:
    """Rows of the given versions with `version` (and `deleted` for claims), those of compacted tenants from their compaction on."""
    schema = f"version bigint, {SCHEMAS[name]}" + (", deleted boolean" if name == "claims" else "")
    folders = [f"{path}/{name}/version={c.version}" for c in versions]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)
    floors = log.floors()
    if floors:
        floor = F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])
        rows = rows.where(F.col("version") >= F.coalesce(F.try_element_at(floor, F.col("tenant")), F.lit(0)))
    return rows


def _current(spark: SparkSession, path: str, log: Log) -> dict[str, DataFrame]:
    """Tables of the latest version of every claim, with `version`."""
    versions = _read_versions(spark, path, log)
    tables = {name: _versions(spark, path, name, log, versions) for name in TABLES}
    if len(versions) <= 1 and all(c.kind != "delete" for c in versions):
        return {**tables, "claims": tables["claims"].drop("deleted")}
    latest = F.max("version").over(Window.partitionBy(*KEYS))  # of a claim, as many rows as it has live versions
    claims = tables["claims"].withColumn("_latest", latest).where((F.col("version") == F.col("_latest")) & ~F.col("deleted")).drop("deleted", "_latest")
    keys = claims.select(*KEYS, "version").distinct()
    return {"claims": claims, **{name: tables[name].join(keys, [*KEYS, "version"], "left_semi") for name in TABLES[1:]}}


def read_store(spark: SparkSession, path: str) -> Store:
    tables = _current(spark, path, read_log(spark, path))
    return Store(*[tables[t].select(*_columns(t)) for t in TABLES])


def _write(path: str, name: str, version: int, rows: DataFrame) -> None:
    rows.write.mode("overwrite").partitionBy("tenant").parquet(f"{path}/{name}/version={version}")


def _commit(spark: SparkSession, path: str, version: int, kind: str, n_rows: int, batch: str | None = None, tenants: list[str] | None = None) -> None:
    row = spark.createDataFrame([(version, kind, batch, tenants, n_rows)], COMMITS)
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/{version}")


def _n_rows(spark: SparkSession, path: str, version: int) -> int:
    """Rows of a version's tables, from the footers of its files."""
    return sum(spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}/version={version}").count() for name in TABLES)


def save_store(path: str, new: Store, batch: str | None = None, compacting: bool = True) -> bool:
    """Append whole claims: no row that a claim had before is read any more. A named batch is saved once: False if it already was.

    Folders of a version that was never committed are written over.
    """
    spark = new.claims.sparkSession
    log = read_log(spark, path)
    if batch is not None and any(c.batch == batch for c in log.commits):
        return False
    version = log.latest + 1
    for name in TABLES[::-1]:
        rows = getattr(new, name).select(*_columns(name))
        _write(path, name, version, rows.withColumn("deleted", F.lit(False)) if name == "claims" else rows)
    written = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}/version={version}") for name in TABLES}
    for name in TABLES[1:]:
        if not orphans(written[name], written["claims"]).isEmpty():
            raise ValueError(f"{name} holds rows of claims that are not being saved")
    _commit(spark, path, version, "save", _n_rows(spark, path, version), batch)
    if compacting and read_log(spark, path).due():
        compact(spark, path)
        vacuum(spark, path)
    return True


def delete_claims(path: str, keys: DataFrame) -> None:
    """Append tombstones of claims: they, their findings and their gaps are not read any more. Keys that are not stored change nothing."""
    spark = keys.sparkSession
    log = read_log(spark, path)
    version = log.latest + 1
    known = _current(spark, path, log)["claims"].select(*KEYS).join(keys.select(*KEYS), KEYS, "left_semi").distinct()
    empty = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in SCHEMAS["claims"].split(", ")) if c not in KEYS]
    for name in TABLES[1:]:
        _write(path, name, version, spark.createDataFrame([], SCHEMAS[name]))
    _write(path, "claims", version, known.select(*KEYS, *empty, F.lit(True).alias("deleted")))
    n = _n_rows(spark, path, version)
    if n:
        _commit(spark, path, version, "delete", n)


def compact(spark: SparkSession, path: str, tenants: list[str] | None = None) -> None:
    """Write the current state, of all tenants or of some, as one version that takes the place of all earlier ones."""
    log = read_log(spark, path)
    if not log.live:
        return
    version = log.latest + 1
    for name, rows in list(_current(spark, path, log).items())[::-1]:
        rows = rows if tenants is None else rows.where(F.col("tenant").isin(tenants))
        rows = rows.select(*_columns(name))
        _write(path, name, version, rows.withColumn("deleted", F.lit(False)) if name == "claims" else rows)
    _commit(spark, path, version, "compact", _n_rows(spark, path, version), tenants=tenants)


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the files that no reader takes any more: versions before the last compaction, and versions without a commit.

    The commit rows of dead versions stay, as what tells a repeated batch, but move to one file when they are many.
    """
    log = read_log(spark, path)
    fs, top = _folder(spark, f"{path}/commits")
    old = [f.getPath() for f in (fs.listStatus(top) if fs.exists(top) else []) if f.getPath().getName().isdigit() and int(f.getPath().getName()) < log.floor]
    if len(old) > MAX_OLD_COMMITS:
        dead = [tuple(c) for c in log.commits if c.version < log.floor]
        spark.createDataFrame(dead, COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/before-{log.floor}")
        for folder in old:
            fs.delete(folder, True)
    floors, live = log.floors(), {c.version for c in log.live}
    for name in TABLES:
        fs, top = _folder(spark, f"{path}/{name}")
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            label, _, number = folder.getPath().getName().partition("=")
            if label != "version":
                continue
            if int(number) not in live:
                fs.delete(folder.getPath(), True)
                continue
            for part in fs.listStatus(folder.getPath()):
                tenant = _tenant(spark, part.getPath().getName())
                if part.isDirectory() and int(number) < floors.get(tenant, 0):
                    fs.delete(part.getPath(), True)


def erase(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Remove claims from the store and from its files; this rewrites the tenants they belong to."""
    tenants = sorted(r.tenant for r in keys.select("tenant").distinct().collect() if r.tenant is not None)
    delete_claims(path, keys)
    if tenants:
        compact(spark, path, tenants)
    vacuum(spark, path)


def exact_money(df: DataFrame) -> DataFrame:
    """Add DECIMAL rupees for every paise column."""
    return df.withColumns({name: from_paise(F.col(p)) for name, p in MONEY.items() if p in df.columns})


def rupee_view(df: DataFrame) -> DataFrame:
    """Whole rupees, truncated, next to the paise they come from."""
    return df.withColumns({name: F.call_function("div", F.col(p), F.lit(100)) for name, p in MONEY.items() if p in df.columns})


def scoped(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.where(F.col("tenant") == tenant)


def register_views(spark: SparkSession, store: Store, tenant: str | None = None) -> None:
    """v_claims, v_findings and doc_gaps of one tenant (all tenants for None) in the session `spark`.

    Queries name no tenant and cannot reach another one: the rows are not in the view. The frames may belong to another session
    of the application; they pass over under a global name that is gone at once.
    """
    for name, df in (("v_claims", rupee_view(store.claims)), ("v_findings", rupee_view(store.findings)), ("doc_gaps", store.doc_gaps)):
        passing = f"pass_{uuid.uuid4().hex}"
        scoped(df, tenant).createGlobalTempView(passing)
        spark.table(f"global_temp.{passing}").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(passing)


# --- reads -------------------------------------------------------------------


def list_claims(claims: DataFrame, query: str = "", month: str = "", limit: int = 50, offset: int = 0,
                tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest first. `query` matches claim id or diagnosis, with SQL wildcards in it."""
    rows = scoped(claims, tenant)
    if query.strip():
        like = f"%{query.strip()}%"
        rows = rows.where(F.col("claim_id").ilike(like) | F.col("diagnosis").ilike(like))
    if month.strip():
        rows = rows.where(F.col("month") == month.strip())
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = exact_money(rows).orderBy(F.desc("audited_at"), "claim_id", "tenant").offset(max(0, offset)).limit(max(1, min(limit, 200)))
    return page, total


def claim_findings(findings: DataFrame, claim_id: str, tenant: str | None = None) -> DataFrame:
    return exact_money(scoped(findings, tenant).where(F.col("claim_id") == claim_id)).orderBy("line_no")


def claim_gaps(gaps: DataFrame, claim_id: str, tenant: str | None = None) -> DataFrame:
    return scoped(gaps, tenant).where(F.col("claim_id") == claim_id).select(*KEYS, "document_id", "name", "severity")


def get_claim(store: Store, claim_id: str, tenant: str | None = None) -> DataFrame:
    """One stored audit with its findings and gaps nested; no row when the tenant does not own it."""
    pick = lambda df: scoped(df, tenant).where(F.col("claim_id") == claim_id)
    lines = pick(store.findings).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "line_no", "description", "head", "classification", "bearer", "amount_paise", "deducted_paise", "cited_chunk_id"))).alias("findings"))
    gaps = pick(store.doc_gaps).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("document_id", "name", "severity"))).alias("document_gaps"))
    return exact_money(pick(store.claims)).join(lines, KEYS, "left").join(gaps, KEYS, "left")


def months(claims: DataFrame, tenant: str | None = None) -> DataFrame:
    return scoped(claims, tenant).select("month").distinct().orderBy(F.desc("month"))
