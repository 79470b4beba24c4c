"""Readers and writers of the standard result and RDF formats."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import datatype
from ..operators.solutions import Solutions

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"


def _unescaped(text: Column) -> Column:
    r"""``\t \b \n \r \f \" \' \\ \uXXXX \UXXXXXXXX`` as their characters, in one pass."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    simple = F.create_map(*(F.lit(x) for pair in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'"), ("\\", "\\")) for x in pair))

    def one(part: Column) -> Column:
        code = F.lpad(F.substring(part, F.lit(3), F.length(part)), 8, "0")
        wide = F.decode(F.unhex(code), "UTF-32")
        letter = F.substring(part, 2, 1)
        return F.when(~part.startswith("\\"), part).when(letter.isin("u", "U"), wide).otherwise(F.coalesce(simple[letter], letter))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of N-Triples files that are neither triples, comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """N-Triples files as a triple table.

    Columns: ``subject_uri, predicate, object_uri, object_value,
    object_language, object_datatype``. A line that is no triple, comment or
    blank line fails a ``strict`` read and else is left out; ``malformed``
    shows such lines.
    """
    line = F.col("value")
    part = lambda i: F.regexp_extract(line, _LINE, i)
    bare = lambda c: _unescaped(F.regexp_replace(c, "^<|>$", ""))
    lines = spark.read.text(path).where(~line.rlike(r"^\s*(#.*)?$"))
    if strict:
        lines = lines.withColumn("value", F.when(line.rlike(_LINE), line).otherwise(F.raise_error(F.concat(F.lit("no triple: "), line))))
    rows = lines.where(line.rlike(_LINE)).select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), part(3).alias("o"))
    literal = F.col("o").startswith('"')
    value = _unescaped(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    tail = lambda p: F.nullif(F.regexp_extract("o", p, 1), F.lit(""))
    return rows.select(
        F.col("s").alias("subject_uri"),
        F.col("p").alias("predicate"),
        F.when(~literal, bare(F.col("o"))).alias("object_uri"),
        F.when(literal, value).alias("object_value"),
        F.when(literal, tail(r'"@([A-Za-z0-9-]+)$')).alias("object_language"),
        F.when(literal, tail(r'"\^\^<([^>]*)>$')).alias("object_datatype"),
    )


def ntriples(triples: DataFrame) -> DataFrame:
    """``subject, predicate, object`` as lines, for ``write.text``."""

    def node(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    text = F.col("object")
    for char, code in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        text = F.replace(text, F.lit(char), F.lit(code))
    iri = F.col("object").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://\S+|urn:\S+|_:\S+)$")
    object_ = F.when(iri, node("object")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return triples.select(F.concat_ws(" ", node("subject"), node("predicate"), object_, F.lit(".")).alias("value"))


def write_results(found: Solutions, path: str, form: str = "csv") -> None:
    """Solutions as files, in parallel: csv, tsv or json (one object a line)."""
    df = found.frame()
    if form == "json":
        df.write.json(path)
    else:
        df.write.csv(path, header=True, sep="," if form == "csv" else "\t")


def result_lines(found: Solutions, form: str, max_rows: int | None = None, languages: Mapping[str, str] | None = None) -> Iterator[str]:
    """SPARQL results as text: json, xml, csv or tsv; rows come one partition at a time.

    ``languages`` names for a variable the one that holds its language tags;
    that is not shown itself. IRIs that start with ``_:`` are blank nodes.
    """
    languages = dict(languages or {})
    whole = found.frame()
    types = dict(whole.dtypes)
    names = [n for n in whole.columns if n not in languages.values()]
    df = whole.select(*names, *(F.col(t).alias(f"lang of {n}") for n, t in languages.items()))
    iri = {n for n, v in found.vars.items() if v.prefix is not None}
    kinds = {n: None if n in iri or types[n] == "string" else datatype(F.col(n), types[n]) for n in names}
    shown = df if max_rows is None else df.limit(max_rows)
    rows = shown.select(*(F.struct(F.col(n).cast("string").alias("v"), (F.lit(None).cast("string") if kinds[n] is None else kinds[n]).alias("t"), (F.col(f"`lang of {n}`") if n in languages else F.lit(None).cast("string")).alias("l")).alias(n) for n in names))

    def quoted(s: str) -> str:
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s

    def json_text(s: str) -> str:
        import json

        return json.dumps(s, ensure_ascii=False)

    def kind(n: str, v: str) -> str:
        return "literal" if n not in iri else "bnode" if v.startswith("_:") else "uri"

    def cell(n: str, v: str, t: str | None, tag: str | None) -> str:
        shown = v.removeprefix("_:") if kind(n, v) == "bnode" else v
        more = f',"datatype":{json_text(t)}' if t else f',"xml:lang":{json_text(tag)}' if tag else ""
        return f'{json_text(n)}:{{"type":"{kind(n, v)}","value":{json_text(shown)}{more}}}'

    def tsv(n: str, v: str, t: str | None, tag: str | None) -> str:
        text = v.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
        literal = f'"{text}"' + (f"^^<{t}>" if t else f"@{tag}" if tag else "")
        return {"literal": literal, "bnode": v, "uri": f"<{v}>"}[kind(n, v)]

    def xml(n: str, v: str, t: str | None, tag: str | None) -> str:
        if kind(n, v) != "literal":
            return f"<uri>{escape(v)}</uri>" if kind(n, v) == "uri" else f"<bnode>{escape(v.removeprefix('_:'))}</bnode>"
        more = f" datatype={quoteattr(t)}" if t else f" xml:lang={quoteattr(tag)}" if tag else ""
        return f"<literal{more}>{escape(v)}</literal>"

    if form == "csv":
        yield ",".join(names) + "\r\n"
    elif form == "tsv":
        yield "\t".join("?" + n for n in names) + "\n"
    elif form == "json":
        yield '{"head":{"vars":[' + ",".join(map(json_text, names)) + ']},"results":{"bindings":['
    else:
        yield '<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>'
        yield "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>"
    first = True
    for row in rows.toLocalIterator():
        bound = [(n, row[n]["v"], row[n]["t"], row[n]["l"]) for n in names if row[n]["v"] is not None]
        if form == "csv":
            yield ",".join(quoted(row[n]["v"] or "") for n in names) + "\r\n"
        elif form == "tsv":
            yield "\t".join("" if row[n]["v"] is None else tsv(n, row[n]["v"], row[n]["t"], row[n]["l"]) for n in names) + "\n"
        elif form == "json":
            yield ("" if first else ",") + "{" + ",".join(cell(*b) for b in bound) + "}"
        else:
            inner = "".join(f"<binding name={quoteattr(x[0])}>{xml(*x)}</binding>" for x in bound)
            yield f"<result>{inner}</result>"
        first = False
    if form == "json":
        yield "]}}"
    elif form == "xml":
        yield "</results></sparql>"


def ask_text(answer: bool, form: str) -> str:
    word = str(answer).lower()
    if form == "json":
        return f'{{"head":{{}},"boolean":{word}}}'
    if form == "xml":
        return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>'
    return f"_askResult\r\n{word}\r\n" if form == "csv" else f"?_askResult\n{word}\n"
