"""One valid file from many tasks: reports in SARIF, JSON, HTML or Markdown.

Each task writes the texts of its rows as parts; the driver's commit copies a template with the parts in their order into one file, a block at a time, and moves it to its name. Until then nothing
stands there, and a job that fails removes its parts. So the rows of a report are never collected, however many there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from siftkite.sources.sinks import sarif_results, sarif_rules

_BLOCK = 1 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Parts(WriterCommitMessage):
    """(partition, section, path) of what a task wrote."""

    written: list


class SectionsWriter(DataSourceWriter):
    def __init__(self, path: str, template: list[str], separator: str):
        self.path, self.template, self.separator = path, template, separator
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Parts:
        from pyspark import TaskContext

        store, base = _store(self.parts)
        store.create_dir(base, recursive=True)
        partition, out, written, section = TaskContext.get().partitionId(), None, [], None
        try:
            for row in iterator:
                if row.section != section:
                    if out is not None:
                        out.close()
                    section = row.section
                    name = f"{partition:08d}-{section}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=_BLOCK)
                    written.append((partition, section, name))
                else:
                    out.write(self.separator.encode())
                out.write(row.text.encode())
        finally:
            if out is not None:
                out.close()
        return Parts(written)

    def commit(self, messages: list) -> None:
        store, target = _store(self.path)
        _, base = _store(self.parts)
        of = sorted(w for m in messages if m is not None for w in m.written)
        if "/" in target:
            store.create_dir(target.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{target}.new", compression=None, buffer_size=_BLOCK) as out:
            for k, text in enumerate(self.template):
                out.write(text.encode())
                for i, (_, _, name) in enumerate(w for w in of if w[1] == k):
                    out.write(self.separator.encode() if i else b"")
                    with store.open_input_stream(f"{base}/{name}", compression=None) as part:
                        while block := part.read(_BLOCK):
                            out.write(block)
        store.move(f"{target}.new", target)
        self._clear(store, base)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.parts))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)


class SectionsSource(DataSource):
    """Format `sections`, for writing: options path, template (a JSON list of the texts before, between and after the sections) and separator; rows of section (int, from 0) and text, sections ascending."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return "section int, text string"

    def writer(self, schema, overwrite: bool) -> SectionsWriter:
        return SectionsWriter(self.options["path"], json.loads(self.options["template"]), self.options["separator"])


def write_sections(sections: Sequence[tuple[DataFrame, str, Sequence]], path: str, template: Sequence[str], separator: str) -> None:
    """Write one file at `path` (a URI, replaced if it is there): the template's texts, and between them the sections, each a column of a DataFrame in the order of some of its columns. Null texts are left out."""
    if len(template) != len(sections) + 1:
        raise ValueError("a template has a text before, between and after its sections")
    keys = max(len(order) for *_, order in sections)
    parts = None
    for k, (df, text, order) in enumerate(sections):
        # orders of different types are compared as places within their own section
        placed = df.filter(F.col(text).isNotNull()).select(F.lit(k).alias("section"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.lit(None).cast("string").alias(f"n{i}") for i in range(keys - len(order))]).alias("o"), F.col(text).cast("string").alias("text"))
        placed = placed.repartitionByRange("o").sortWithinPartitions("o").select("section", "text")
        parts = placed if parts is None else parts.union(placed)  # partitions of a union stand in its order
    spark = parts.sparkSession
    spark.dataSource.register(SectionsSource)
    parts.write.format("sections").mode("append").option("path", path).option("template", json.dumps(list(template))).option("separator", separator).save()


# Fixed values of the format.
SARIF_SCHEMA, SARIF_VERSION = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "2.1.0"


def write_sarif(findings: DataFrame, path: str, tool: str, version: str = "1.0.0") -> None:
    """One SARIF file of all findings (pos, rule_id, description, severity, file_path, line), in order of pos, with a definition of each rule by its first finding."""
    rules = sarif_rules(findings).withColumn("id", F.get_json_object("rule", "$.id"))
    results = sarif_results(findings, keep=["pos"])
    driver = json.dumps({"name": tool, "version": version})[:-1]
    template = [f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"version":{json.dumps(SARIF_VERSION)},"runs":[{{"tool":{{"driver":{driver},"rules":[', ']}},"results":[', "]}]}"]
    write_sections([(rules, "rule", ["id"]), (results, "result", ["pos"])], path, template, ",\n")


def write_json_report(rows: DataFrame, path: str, order: Sequence[str], head: dict | None = None, name: str = "findings") -> None:
    """One JSON object: the fields of head, then all rows as an array of objects, null fields included."""
    made = rows.select("*", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_text"))
    begin = json.dumps(head or {})[:-1]
    write_sections([(made, "_text", order)], path, [f"{begin}{',' if head else ''}{json.dumps(name)}:[", "]}"], ",\n")


def write_html_report(rows: DataFrame, path: str, order: Sequence[str], title: str) -> None:
    """One HTML page with a table of all rows; values are escaped, nulls are empty."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    made = rows.select("*", F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in rows.columns], F.lit("</tr>")).alias("_text"))
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in rows.columns)}</tr>\n"
    write_sections([(made, "_text", order)], path, [head, "\n</table></body></html>\n"], "\n")
