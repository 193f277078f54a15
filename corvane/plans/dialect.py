"""The few expressions that Spark SQL and DuckDB spell differently, so that a relational query is stated once."""

from __future__ import annotations


class Spark:
    name = "spark"

    def agg(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def lines(self, table: str, columns: str) -> str:
        return f"(SELECT {columns}, pos, line FROM {table} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line)"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def replaced(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def day(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def part(self, x: str, sep: str, k: int) -> str:
        return f"split_part({x}, '{sep}', {k})"


class Duck(Spark):
    name = "duckdb"

    def agg(self, x: str) -> str:
        return f"coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}), '')"

    def lines(self, table: str, columns: str) -> str:
        return f"(SELECT {columns}, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT *, string_split(text, chr(10)) AS p FROM {table}))"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def replaced(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"
