"""SQL text for targets that merge on their own server."""

from __future__ import annotations

from dataclasses import dataclass, field


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Delivery:
    """Names of a staging and a target table; geometry columns are WKB in the staging table."""

    staging: str
    target: str
    operation: str = "update_type"
    srid: int = 0
    geometry: list[str] = field(default_factory=list)

    def column(self, name: str) -> str:
        ref = f"{self.staging}.{quoted(name)}"
        return f"ST_GeomFromWKB({ref}, {self.srid})" if name in self.geometry else ref

    def snapshot(self, columns: list[str]) -> list[str]:
        """Statements of one transaction that replaces the target by the staging table, all its columns."""
        names, values = ", ".join(map(quoted, columns)), ", ".join(map(self.column, columns))
        return [f"TRUNCATE TABLE {self.target}", f"INSERT INTO {self.target} ({names}) SELECT {values} FROM {self.staging}"]

    def merge(self, columns: list[str], keys: list[str]) -> str:
        """One statement that deletes, updates and inserts. Without a column to update, matched rows stay as they are."""
        if not keys:
            raise ValueError("a merge needs keys")
        op = f"{self.staging}.{quoted(self.operation)}"
        on = " AND ".join(f"{self.target}.{quoted(k)} = {self.staging}.{quoted(k)}" for k in keys)
        own = [c for c in columns if c != self.operation]
        sets = ", ".join(f"{quoted(c)} = {self.column(c)}" for c in own if c not in keys)
        update = f" WHEN MATCHED AND {op} <> 'delete' THEN UPDATE SET {sets}" if sets else ""
        insert = f"INSERT ({', '.join(map(quoted, own))}) VALUES ({', '.join(map(self.column, own))})"
        return f"MERGE INTO {self.target} USING {self.staging} ON {on} WHEN MATCHED AND {op} = 'delete' THEN DELETE{update} WHEN NOT MATCHED AND {op} <> 'delete' THEN {insert}"
