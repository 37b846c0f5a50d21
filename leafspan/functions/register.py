"""The kernels as functions of a session's SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.flatten import document_of, parse
from . import kernels

#: name(parameters) returns type: body. All are SQL, so Catalyst takes them in place of the call.
FUNCTIONS = {
    "char_sim(a string, b string) returns double": "case when a = b then 1.0d else greatest(0.0d, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) end",
    "numbers_close(a double, b double) returns boolean": f"case when a = 0 or b = 0 then abs(a - b) <= {kernels.AT_ZERO}d else abs(a - b) <= {kernels.RELATIVE}d * greatest(abs(a), abs(b)) end",
    "numbers_within(a double, b double, absolute double, relative double) returns boolean": "abs(a - b) <= greatest(absolute, relative * greatest(abs(a), abs(b)))",
    "field_sim(a string, b string) returns double": "sqrt(case when a = b then 1.0d else greatest(0.0d, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) end)",
    "json_readable(a string) returns boolean": "try_parse_json(a) is not null",
}


@udtf(returnType="path string, vtype string, sval string, nval double, bval boolean")
class FlattenJson:
    """The leaves of a JSON text; none if it cannot be read."""

    def eval(self, text: str):
        ok, value = parse(text)
        if ok:
            for path, leaf in document_of(value).items():
                yield path, leaf["vtype"], leaf["sval"], leaf["nval"], leaf["bval"]


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session, as temporary ones, and the table function flatten_json(text)."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udtf.register("flatten_json", FlattenJson)
