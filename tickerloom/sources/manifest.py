"""Stage cache: time-to-live and signature checks over small JSON sidecars."""

from __future__ import annotations

import datetime as dt
import json
import time

from pyspark.sql import SparkSession

from .readers import Folder

SUFFIX = ".cache_meta.json"


class Manifest:
    """Sidecars next to the stage outputs of one folder, on the session's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = Folder(spark, folder)

    def fresh(self, output: str, ttl_days: float, signature: str | None = None, force: bool = False,
              now: float | None = None) -> bool:
        """True when the output exists, is young enough and was built from the same settings."""
        if force or not self._folder.has(output):
            return False
        done = self._folder.join(output)
        stamp = Folder(self._spark, done).modified("_SUCCESS") if Folder(self._spark, done).has("_SUCCESS") \
            else self._folder.modified(output)
        age_days = ((time.time() if now is None else now) - stamp) / 86400.0
        if age_days > ttl_days:
            return False
        return signature is None or self.read(output).get("signature") == signature

    def mark(self, output: str, **extra) -> None:
        """Write the sidecar; a failure is only reported."""
        record = {
            "completed_at": dt.datetime.now(dt.timezone.utc).isoformat(), "output": self._folder.join(output), **extra,
        }
        try:
            out = self._folder._fs.create(self._folder._new(self._folder._path, output + SUFFIX), True)
            try:
                out.write(bytearray(json.dumps(record, indent=2).encode("utf-8")))
            finally:
                out.close()
        except Exception as exc:
            print(f"[cache] could not write the sidecar of {output}: {exc}")

    def tickers(self, output: str) -> dict[str, dict]:
        """Of each ticker in the output: signature and time of its last build."""
        return self.read(output).get("tickers", {})

    def ticker_fresh(self, output: str, ticker: str, ttl_days: float, signature: str, now: float | None = None) -> bool:
        entry = self.tickers(output).get(ticker)
        if not entry or entry["signature"] != signature or not self._folder.has(output):
            return False
        done = dt.datetime.fromisoformat(entry["completed_at"]).timestamp()
        return ((time.time() if now is None else now) - done) / 86400.0 <= ttl_days

    def forget(self, output: str, tickers: list[str]) -> None:
        old = self.read(output)
        kept = {t: e for t, e in self.tickers(output).items() if t not in tickers}
        self.mark(output, tickers=kept, inputs=old.get("inputs", {}), schema=old.get("schema"))

    def mark_tickers(self, output: str, signatures: dict[str, str], inputs: dict[str, list] | None = None, schema: str | None = None) -> None:
        """Entries of rebuilt tickers; digests of the input files and the table's schema, where known, are kept beside them."""
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        fresh = {t: {"signature": s, "completed_at": now} for t, s in signatures.items()}
        old = self.read(output)
        self.mark(
            output, tickers={**self.tickers(output), **fresh}, inputs={**old.get("inputs", {}), **(inputs or {})}, schema=schema or old.get("schema"))

    def read(self, output: str) -> dict:
        """The sidecar's content; empty when missing or unreadable."""
        name = output + SUFFIX
        if not self._folder.has(name):
            return {}
        try:
            rows = self._spark.read.text(self._folder.join(name), wholetext=True).collect()  # one small file
            return json.loads(rows[0][0])
        except Exception:
            return {}
