"""Delivery to a JDBC database: staging write, then snapshot or merge on the server."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from geoledger.plans.merge import DELETE, OPERATION, duplicate_keys
from geoledger.plans.sql_text import Delivery

MODES = ("snapshot", "merge")
#: Environment variables that name the certificate files.
CERTIFICATES = {"sslrootcert": "SYNC_SSL_CA", "sslcert": "SYNC_SSL_CERT", "sslkey": "SYNC_SSL_KEY"}
SecretGetter = Callable[[str, str], str]


@dataclass(frozen=True)
class SslConfig:
    """Certificate files for a connection that verifies the server."""

    sslrootcert: str
    sslcert: str
    sslkey: str

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None) -> SslConfig:
        """RuntimeError names the variables that are absent; FileNotFoundError the files that are."""
        environ = dict(os.environ if environ is None else environ)
        absent = [v for v in CERTIFICATES.values() if not environ.get(v)]
        if absent:
            raise RuntimeError(f"environment variables for certificates are not set: {', '.join(absent)}")
        found = {k: environ[v] for k, v in CERTIFICATES.items()}
        for path in found.values():
            if not os.path.exists(path):
                raise FileNotFoundError(path)
        return cls(**found)

    def options(self) -> dict[str, str]:
        return {"ssl": "true", "sslmode": "verify-ca", "sslrootcert": self.sslrootcert, "sslcert": self.sslcert, "sslkey": self.sslkey}


@dataclass(frozen=True)
class Target:
    """Where to deliver. ``url`` and ``driver`` default to PostgreSQL on the host."""

    host: str
    dbname: str
    user: str
    password: str = field(repr=False)
    staging_table: str = ""
    target_table: str = ""
    update_type_col: str = OPERATION
    srid: int = 0
    url: str | None = None
    driver: str = "org.postgresql.Driver"
    ssl: SslConfig | None = None

    @property
    def jdbc_url(self) -> str:
        return self.url or f"jdbc:postgresql://{self.host}/{self.dbname}"

    @classmethod
    def from_secrets(cls, getter: SecretGetter, scope: str, host_key: str, password_key: str, **rest) -> Target:
        """Host and password come from a secret store; everything else is given."""
        return cls(host=getter(scope, host_key), password=getter(scope, password_key), **rest)


def requires_local_files(setting: str, isolating: tuple[str, ...] = ("USER_ISOLATION",)) -> Callable[[SparkSession], None]:
    """A preflight: RuntimeError if the session's ``setting`` names an access mode that keeps certificate files out of reach."""

    def check(spark: SparkSession) -> None:
        mode = spark.conf.get(setting, "").upper()
        if mode in isolating:
            raise RuntimeError(f"{setting} is {mode}, where code can't read the certificate files; run it where local files can be read")

    return check


def jvm_executor(spark: SparkSession, target: Target) -> Callable[[list[str]], int]:
    """Runs statements in one transaction over the session's JVM; returns how many rows the last one changed."""

    def run(statements: list[str]) -> int:
        jvm = spark._jvm
        jvm.java.lang.Class.forName(target.driver, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = jvm.java.util.Properties()
        for k, v in ({"user": target.user, "password": target.password} | (target.ssl.options() if target.ssl else {})).items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(target.jdbc_url, properties)
        try:
            connection.setAutoCommit(False)
            statement, changed = connection.createStatement(), 0
            for text in statements:
                changed = statement.executeUpdate(text)
            connection.commit()
            return changed
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return run


class SyncManager:
    """Brings a DataFrame to a target table."""

    def __init__(self, target: Target, spark: SparkSession, execute: Callable[[list[str]], int] | None = None, preflight: Callable[[SparkSession], None] | None = None):
        """preflight is called before every delivery and raises if it must not run here."""
        self.target, self.spark, self._preflight = target, spark, preflight
        self._execute = execute or jvm_executor(spark, target)

    def write_staging(self, df: DataFrame) -> None:
        """Replace the staging rows, keeping the table's definition; each partition writes over its own connection."""
        options = {"url": self.target.jdbc_url, "dbtable": self.target.staging_table, "user": self.target.user, "password": self.target.password, "driver": self.target.driver, "truncate": "true"}
        df.write.format("jdbc").options(**options, **(self.target.ssl.options() if self.target.ssl else {})).mode("overwrite").save()

    def sync(self, df: DataFrame, mode: str = "snapshot", merge_keys: list[str] | None = None, geometry_cols: list[str] | None = None) -> int:
        """Deliver; the number of rows the server reports. Mode, keys and repeated keys are checked before anything is written."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "merge" and not merge_keys:
            raise ValueError("a merge needs keys")
        if self._preflight:
            self._preflight(self.spark)
        if mode == "merge":
            df = df.persist()  # the check and the delivery run the feed's plan once
        try:
            if mode == "merge" and not duplicate_keys(df, merge_keys).isEmpty():
                raise ValueError("the feed has a key more than once")
            self.write_staging(df)
        finally:
            if mode == "merge":
                df.unpersist()
        text = Delivery(self.target.staging_table, self.target.target_table, self.target.update_type_col, self.target.srid, geometry_cols or [])
        return self._execute(text.snapshot(df.columns) if mode == "snapshot" else [text.merge(df.columns, merge_keys)])


__all__ = ["DELETE", "MODES", "SslConfig", "SyncManager", "Target", "jvm_executor", "requires_local_files"]
