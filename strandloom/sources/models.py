"""Model files: headers of profile databases as expressions over records, and their score tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def score_token(token: Column | str) -> Column:
    """A number of a model file: * and -inf are minus infinity, *N is N / 1000, a share of 1 becomes its log odds, a whole number under -1000 is N / 1000; null for what is no number."""
    t = F.trim(F.col(token) if isinstance(token, str) else token)
    x = t.try_cast("double")
    scaled = F.regexp_extract(t, r"^\*([+-]?\d+)$", 1).try_cast("double")
    return (
        F.when(t.isin("*", "-inf", "-Inf", "-INF"), float("-inf"))
        .when(t.rlike(r"^\*[+-]?\d+$"), scaled / 1000.0)
        .when((x > 0) & (x < 1), F.log(x / (1 - x)))
        .when((x < -1000) & (x == F.floor(x)), x / 1000.0)
        .otherwise(x)
    )


def model_headers(records: DataFrame, value: str = "value") -> DataFrame:
    """name, accession, description, length, alphabet, ga, tc, nc of records of profile databases; records without a name go."""
    field = lambda key, what=r"(.*?)": F.nullif(F.regexp_extract(value, rf"(?m)^{key}\s+{what}\s*$", 1), F.lit(""))
    cutoff = lambda key: F.nullif(F.regexp_extract(value, rf"(?m)^{key}\s+([-+0-9.eE]+)", 1), F.lit("")).try_cast("double")
    rows = records.select(field("NAME").alias("name"), field("ACC").alias("accession"), field("DESC").alias("description"), field("LENG", r"(\d+)").cast("int").alias("length"), field("ALPH").alias("alphabet"), *(cutoff(k.upper()).alias(k) for k in ("ga", "tc", "nc")))
    return rows.where("name is not null")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Headers of the models of database files; a model ends with a line of //, so files are split between tasks."""
    return model_headers(spark.read.option("lineSep", "//\n").text(path))


def detect_format(content: Column | str) -> Column:
    """HMMER3, STOCKHOLM, HMMSEARCH or INTERPRO by what a text holds, in this order; null for others."""
    c = F.col(content) if isinstance(content, str) else content
    return (
        F.when(c.rlike(r"^HMMER3/"), "HMMER3")
        .when(c.rlike(r"# STOCKHOLM|(?m)^#=GF "), "STOCKHOLM")
        .when(c.rlike(r"(?m)^# hmmsearch|(?m)^Query:\s"), "HMMSEARCH")
        .when(c.rlike(r"(?m)^(ID|AC)\s+IPR\d{6}"), "INTERPRO")
    )


# Where each format keeps a field, as a pattern over the whole text.
FIELDS = {
    "HMMER3": {"name": r"(?m)^NAME\s+(\S+)", "accession": r"(?m)^ACC\s+(\S+)", "description": r"(?m)^DESC\s+(.*?)\s*$", "length": r"(?m)^LENG\s+(\d+)"},
    "STOCKHOLM": {"name": r"(?m)^#=GF ID\s+(\S+)", "accession": r"(?m)^#=GF AC\s+(\S+)", "description": r"(?m)^#=GF DE\s+(.*?)\s*$", "length": r"(?m)^#=GF LEN\s+(\d+)"},
    "HMMSEARCH": {"name": r"(?m)^Query:\s+(\S+)", "accession": r"(?m)^Accession:\s+(\S+)", "description": r"(?m)^Description:\s*(.*?)\s*$", "length": r"(?m)^Query:.*\[M=\s*(\d+)\s*\]"},
    "INTERPRO": {"name": r"(?m)^ID\s+(\S+)", "accession": r"(?m)^AC\s+(\S+)", "description": r"(?m)^DE\s+(.*?)\s*$", "length": r"(?m)^\b\B(\d+)"},
}


def any_model(content: Column | str) -> Column:
    """Struct (format, name, accession, description, length) of a text in whichever format it is found to be; null for none."""
    c = F.col(content) if isinstance(content, str) else content
    kind = detect_format(c)

    def field(name: str) -> Column:
        found = F.lit(None).cast("string")
        for k, of in FIELDS.items():
            found = F.when(kind == k, F.nullif(F.regexp_extract(c, of[name], 1), F.lit(""))).otherwise(found)
        return found

    return F.when(kind.isNotNull(), F.struct(kind.alias("format"), field("name").alias("name"), field("accession").alias("accession"), field("description").alias("description"), field("length").try_cast("int").alias("length")))


def read_any_models(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, whatever its format."""
    return spark.read.text(path, wholetext=True).select(any_model("value").alias("m")).where("m is not null").select("m.*")


BODY = "name string, length int, letters string, match array<array<double>>, insert array<array<double>>, transitions array<array<double>>, stats map<string,array<double>>"


def parse_body(text: str) -> dict | None:
    """A whole model: for each node twenty match and insert log probabilities and seven log transitions (m->m m->i m->d i->m i->i d->m d->d). Files hold negative logarithms, * for none. None where no body is found."""
    number = lambda x: float("-inf") if x == "*" else -float(x)
    out = {"name": None, "length": None, "letters": "", "match": [], "insert": [], "transitions": [], "stats": {}}
    lines = iter(text.splitlines())
    for line in lines:
        f = line.split()
        if not f:
            continue
        if f[0] == "NAME" and len(f) > 1:
            out["name"] = f[1]
        elif f[0] == "LENG" and len(f) > 1:
            out["length"] = int(f[1])
        elif f[0] == "STATS" and len(f) >= 5:
            out["stats"][f"{f[1]} {f[2]}"] = [float(x) for x in f[3:5]]
        elif f[0] == "HMM":
            out["letters"] = "".join(f[1:])
            break
    else:
        return None
    n = len(out["letters"])
    rows = [f for f in (x.split() for x in lines) if f and f[0] != "//"][1:]  # the first names the transitions
    if rows and rows[0][0] == "COMPO":
        rows = rows[1:]
    if len(rows) >= 2:
        out["insert"].append([number(x) for x in rows[0][:n]])
        out["transitions"].append([number(x) for x in rows[1][:7]])
    for k in range(2, len(rows) - 2, 3):
        out["match"].append([number(x) for x in rows[k][1 : n + 1]])
        out["insert"].append([number(x) for x in rows[k + 1][:n]])
        out["transitions"].append([number(x) for x in rows[k + 2][:7]])
    return out


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole models of database files, a row each."""

    @F.pandas_udf(BODY)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [parse_body(t) or {"name": None} for t in texts]
        return pd.DataFrame([{c: m.get(c) for c in ("name", "length", "letters", "match", "insert", "transitions", "stats")} for m in found])

    return spark.read.option("lineSep", "//\n").text(path).select(run("value").alias("m")).where("m.name is not null").select("m.*")


def emission(rows: Column | str, node: Column | str | int, residue: Column | str | int) -> Column:
    """The number of a node and a residue's place in `match` or `insert` of read_bodies; 0 where there is none."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    node, residue = (F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x for x in (node, residue))
    return F.coalesce(F.get(F.get(rows, node), residue), F.lit(0.0))


def transition(rows: Column | str, node: Column | str | int, kind: str) -> Column:
    """The transition of a node, one of mm mi md im ii dm dd, in `transitions` of read_bodies; 0 where there is none."""
    return emission(rows, node, ("mm", "mi", "md", "im", "ii", "dm", "dd").index(kind))
