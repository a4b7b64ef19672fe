"""Rule versions pinned to micro-batches.

A query that reads its rules anew in every micro-batch would, when a batch is tried again after a
crash, judge the same rows by other rules than the first try did. Here the version of the rules is
written down under the query's name and the batch's number before the batch uses it. A retry
finds the entry and gets the same rules; versions are shared by all queries.
"""

import json
import time
import uuid

from pyspark.sql import functions as F

from pulsewatch.sources.tables import folder_path

KEEP_BATCHES = 1_000
LEAST_AGE = 3600


class RuleVersions:
    """Versions of a rule table below `path`, and the log of which batch used which.

    `versions/<name>` holds the rules of a version, named by their content, so that an unchanged
    table is written once however many batches and queries read it. `log/<query>/<batch>` names
    the version of a batch; it is created once and never overwritten.
    """

    def __init__(self, spark, path, load_rules):
        self.spark, self.path, self.load_rules = spark, path.rstrip("/"), load_rules

    def of(self, query):
        """The rules of one query, to be given to it in place of `load_rules`."""
        return QueryRules(self, query)

    def _log(self, query, batch_id):
        return folder_path(self.spark, f"{self.path}/log/{query}/{batch_id}")

    def pinned(self, query, batch_id):
        """The version a batch has been given, or None."""
        file, fs = self._log(query, batch_id)
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()))["version"]
        finally:
            stream.close()

    def store(self, rules):
        """The name of the version these rules are, written out if no batch has used it yet."""
        rows = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(rules.columns)]).cast("decimal(38,0)")
        twice = F.xxhash64(F.lit(1), *[F.to_json(F.struct(F.col(c))) for c in sorted(rules.columns)]).cast("decimal(38,0)")
        told = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(rows).alias("a"), F.sum(twice).alias("b")).first()
        name = f"{told['n']}_{told['a'] or 0}_{told['b'] or 0}".replace("-", "m")
        final, fs = folder_path(self.spark, f"{self.path}/versions/{name}")
        if not fs.exists(final):
            made = f"{self.path}/making/{uuid.uuid4().hex}"
            rules.write.parquet(made)
            fs.mkdirs(final.getParent())
            source = folder_path(self.spark, made)[0]
            if fs.exists(final) or not fs.rename(source, final):
                fs.delete(source, True)
        return name

    def pin(self, query, batch_id):
        """The version of a batch: the one logged, else the rules of now, logged before they are used."""
        known = self.pinned(query, batch_id)
        if known is not None:
            return known
        rules = self.load_rules().persist()
        try:
            name = self.store(rules)
        finally:
            rules.unpersist()
        # Written aside and renamed, as a reader must never see half an entry.
        final, fs = self._log(query, batch_id)
        making = folder_path(self.spark, f"{self.path}/making/{uuid.uuid4().hex}")[0]
        fs.mkdirs(final.getParent())
        out = fs.create(making, False)
        try:
            out.write(bytearray(json.dumps({"version": name}).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(making, final):
            fs.delete(making, False)
            return self.pinned(query, batch_id)
        return name

    def read(self, name):
        """The rules of a version."""
        return self.spark.read.parquet(f"{self.path}/versions/{name}")

    def clean(self, keep_batches=KEEP_BATCHES, least_age=LEAST_AGE):
        """Removes log entries of all but each query's last batches, and versions no entry names.

        Versions written within `least_age` seconds stay, as a batch may be about to be given one.
        """
        log, fs = folder_path(self.spark, f"{self.path}/log")
        named = set()
        for query in fs.listStatus(log) if fs.exists(log) else []:
            entries = sorted(int(s.getPath().getName()) for s in fs.listStatus(query.getPath()))
            for n in entries[:-keep_batches] if keep_batches else entries:
                fs.delete(self._log(query.getPath().getName(), n)[0], False)
            named |= {self.pinned(query.getPath().getName(), n) for n in (entries[-keep_batches:] if keep_batches else [])}
        versions = folder_path(self.spark, f"{self.path}/versions")[0]
        old = (time.time() - least_age) * 1000
        for s in fs.listStatus(versions) if fs.exists(versions) else []:
            if s.getPath().getName() not in named and s.getModificationTime() < old:
                fs.delete(s.getPath(), True)


class QueryRules:
    """The rules of one query: `of_batch` pins them, a plain call reads those of now."""

    def __init__(self, versions, query):
        self.versions, self.query = versions, query

    def __call__(self):
        return self.versions.load_rules()

    def of_batch(self, batch_id):
        return self.versions.read(self.versions.pin(self.query, batch_id))
