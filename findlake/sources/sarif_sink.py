"""A data sink for exported reports: `df.write.format("sarif_documents")` streams one document a repository into a folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from findlake.sources.archive_source import file_system
from findlake.sources.sarif import SCHEMA, exported

#: What the sink takes, in order of repository and place: a result and its rule as JSON.
ROWS = "repo string, place int, rule_index int, result string, rule string"


@dataclass
class Written(WriterCommitMessage):
    documents: int
    results: int


class Documents(DataSourceWriter):
    """Results go to a file as they come, so a task holds the rules of one document and no list of results. A document has
    a name of its own until it is whole, and is then moved to its place: a task that is lost leaves no half document
    there, and one that is repeated moves the same document to the same place."""

    def __init__(self, path: str, tool: str) -> None:
        self.path, self.tool = path, tool

    def write(self, iterator: Iterator[Row]) -> Written:
        store, path = file_system(self.path)
        store.create_dir(path)
        repo, out, part, rules, documents, results = None, None, None, {}, 0, 0

        def finish() -> None:
            tail = {"driver": {"name": self.tool, "rules": [rules[k] for k in sorted(rules)]}}
            out.write(f'],"tool":{json.dumps(tail, ensure_ascii=False)}}}]}}'.encode())
            out.close()
            store.move(part, f"{path}/{quote(repo, safe='')}.sarif")

        try:
            for row in iterator:
                if out is None or row["repo"] != repo:
                    if out is not None:
                        finish()
                        out = None
                    repo, rules, part = row["repo"], {}, f"{path}/.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part, compression=None)
                    out.write(f'{{"$schema":{json.dumps(SCHEMA)},"version":"2.1.0","runs":[{{"results":['.encode())
                    documents += 1
                else:
                    out.write(b",")
                out.write(row["result"].encode())
                rules.setdefault(row["rule_index"], json.loads(row["rule"]))
                results += 1
            if out is not None:
                finish()
                out = None
        finally:
            if out is not None:  # cut off within a document
                out.close()
                store.delete_file(part)
        return Written(documents, results)

    def commit(self, messages: list[Written | None]) -> None:
        """A note of what was written, when all tasks have ended."""
        store, path = file_system(self.path)
        store.create_dir(path)
        done = [m for m in messages if m is not None]
        part = f"{path}/.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as out:
            out.write(json.dumps({"documents": sum(m.documents for m in done), "results": sum(m.results for m in done)}).encode())
        store.move(part, f"{path}/_SUCCESS")

    def abort(self, messages: list[Written | None]) -> None:
        """Whole documents may stay; the note is missing."""


class SarifDocuments(DataSource):
    """Options: path; tool, the name in the documents."""

    @classmethod
    def name(cls) -> str:
        return "sarif_documents"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> Documents:
        return Documents(self.options["path"], self.options.get("tool", "findlake"))


def write_documents(findings: DataFrame, path: str, tool: str = "findlake") -> None:
    """Write the report of each repository of findings as a document named after it, by as many tasks as there are partitions."""
    findings.sparkSession.dataSource.register(SarifDocuments)
    rows = exported(findings).select(F.col("repo").cast("string").alias("repo"), F.col("place").cast("int").alias("place"), F.col("rule_index").cast("int").alias("rule_index"), F.to_json("result").alias("result"), F.to_json("rule").alias("rule"))
    rows.repartition("repo").sortWithinPartitions("repo", "place").write.format("sarif_documents").option("path", path).option("tool", tool).mode("append").save()
