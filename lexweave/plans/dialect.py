"""Queries written once: Spark SQL for the engine, the same statement in DuckDB's dialect as the check on it."""

from __future__ import annotations

from collections.abc import Callable

from .registry import query


class Dialect:
    """What differs between the two. Tables are read by path, so that nothing is left registered in the session."""

    spark = True

    def __init__(self, sf_dir: str = ""):
        self.sf_dir = sf_dir

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`" if self.spark else table

    def _(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def div(self, a: str, b: str | int) -> str:
        return self._(f"(({a}) div {b})", f"(({a}) // {b})")

    def rx(self, x: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return self._(f"({x} rlike r'{p}')" if "'" not in p else f"({x} rlike '{p}')", f"regexp_matches({x}, '{p}')")

    def rr(self, x: str, pattern: str, by: str) -> str:
        """Replace all; groups as \\1."""
        return self._(f"regexp_replace({x}, r'{pattern}', '{by.replace(chr(92), '$')}')", f"regexp_replace({x}, '{pattern}', '{by}', 'g')")

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return self._(f"regexp_extract({x}, r'{pattern}', {group})", f"regexp_extract({x}, '{pattern}', {group})")

    def find_all(self, x: str, pattern: str) -> str:
        return self._(f"regexp_extract_all({x}, r'{pattern}', 0)", f"regexp_extract_all({x}, '{pattern}')")

    def sha(self, x: str) -> str:
        return self._(f"sha2({x}, 256)", f"sha256({x})")

    def size(self, a: str) -> str:
        return self._(f"CAST(size({a}) AS BIGINT)", f"CAST(len({a}) AS BIGINT)")

    def at(self, a: str, i: str | int) -> str:
        return self._(f"try_element_at({a}, CAST({i} AS INT))", f"({a})[{i}]")

    def slice(self, a: str, start: str | int, n: str | int) -> str:
        return self._(f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))", f"list_slice({a}, {start}, ({start}) + ({n}) - 1)")

    def join(self, a: str, sep: str = " ") -> str:
        return self._(f"array_join({a}, '{sep}')", f"coalesce(array_to_string({a}, '{sep}'), '')")

    def split(self, x: str, sep: str) -> str:
        return self._(f"split({x}, '{sep}')", f"string_split({x}, '{sep}')")

    def keep(self, a: str, x: str, cond: str) -> str:
        return self._(f"filter({a}, {x} -> {cond})", f"list_filter({a}, lambda {x}: {cond})")

    def each(self, a: str, x: str, value: str) -> str:
        return self._(f"transform({a}, {x} -> {value})", f"list_transform({a}, lambda {x}: {value})")

    def bind(self, x: str, name: str, body: str) -> str:
        """``body`` with ``name`` for the value of ``x``, which is computed once."""
        return self._(f"element_at(transform(array({x}), {name} -> {body}), 1)", f"list_transform([{x}], lambda {name}: {body})[1]")

    def has(self, a: str, x: str) -> str:
        return self._(f"array_contains({a}, {x})", f"list_contains({a}, {x})")

    def distinct(self, a: str) -> str:
        return self._(f"sort_array(array_distinct({a}))", f"list_sort(list_distinct({a}))")

    def common(self, a: str, b: str) -> str:
        return self._(f"sort_array(array_intersect({a}, {b}))", f"list_sort(list_intersect({a}, {b}))")

    def words(self, x: str) -> str:
        """Lower-case ASCII letters and digits, in runs."""
        w = self.split(self.rr(f"lower({x})", "[^a-z0-9]+", " "), " ")
        return self.keep(w, "w", "w <> ''")

    def lit(self, values: list) -> str:
        items = ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
        return self._(f"array({items.replace(chr(39) * 2, chr(92) + chr(39))})", f"[{items}]")

    def range(self, a: str | int, b: str | int) -> str:
        """Whole numbers from a to b; none if b is less."""
        return self._(f"(CASE WHEN ({b}) >= ({a}) THEN sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) ELSE array() END)", f"generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))")

    def unnest(self, columns: str, source: str, array: str, item: str, pos: str = "pos") -> str:
        """A row for each element, its place from 1."""
        return self._(
            f"(SELECT {columns}, __p + 1 AS {pos}, {item} FROM (SELECT *, {array} AS __a FROM {source}) LATERAL VIEW posexplode(__a) __e AS __p, {item})",
            f"(SELECT {columns}, {pos}, {item} FROM (SELECT {columns}, unnest({array}) AS {item}, generate_subscripts({array}, 1) AS {pos} FROM {source}) __u)",
        )

    def pick(self, x: str, values: list[str | None]) -> str:
        whens = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
        return f"CASE {x} {whens} END"

    def sorted_list(self, x: str, sep: str = ",", distinct: bool = False, where: str = "") -> str:
        """Values of a group in one string, in order."""
        d, f = "DISTINCT " if distinct else "", f" FILTER (WHERE {where})" if where else ""
        return self._(f"array_join(sort_array(collect_{'set' if distinct else 'list'}({x}){f}), '{sep}')", f"coalesce(string_agg({d}{x}, '{sep}' ORDER BY {x}){f}, '')")

    def argmax(self, value: str, by: list[str]) -> str:
        order = ", ".join(by)
        return self._(f"max_by({value}, struct({order}))", f"arg_max({value}, row({order}))")

    def argmin(self, value: str, by: list[str]) -> str:
        order = ", ".join(by)
        return self._(f"min_by({value}, struct({order}))", f"arg_min({value}, row({order}))")

    def json_int(self, x: str, key: str) -> str:
        return self._(f"TRY_CAST(get_json_object({x}, '$.{key}') AS BIGINT)", f"TRY_CAST(json_extract_string({x}, '$.{key}') AS BIGINT)")

    # Analogs of the engine's own entities on the supplied tables.

    def attempts(self) -> str:
        """Spend attempts of an episode's ledger."""
        return f"""attempts AS (
            SELECT user_id AS episode_key, event_id AS attempt_id, ts,
                   CASE event_type WHEN 'purchase' THEN 'settled' WHEN 'click' THEN 'reserved' WHEN 'view' THEN 'uncertain' ELSE 'released' END AS state,
                   {self.pick(f"{self.json_int('props', 'k')} % 5", ["transcription", "resolver", "triage", "judge", "note_writer"])} AS stage,
                   {self.json_int("props", "k")} % 7 = 0 AS third, CAST(value AS DECIMAL(18,6)) AS usd
            FROM {self.t("events")})"""

    def cards(self) -> str:
        """Review cards of an episode, some of them decided."""
        d = lambda n, k: f"{self.div('m', n)} % {k}"
        return f"""cards AS (
            SELECT *, {self.pick("m % 6", ["number_mismatch", "negation_mismatch", "wording_difference", "whisper_omission", "whisper_addition", "transcription_difference"])} AS kind,
                   {self.pick(d(7, 3), ["high", "medium", "low"])} AS severity,
                   {self.pick(d(3, 9), ["protocol_number", "unit", "exercise_name", "supplement", "training_term", "citation", "proper_name", "negation", "other"])} AS category,
                   {self.pick(d(11, 5), ["apple", "whisper", "manual", "third_asr", None])} AS chosen_source,
                   {self.pick(d(13, 4), ["apple", "whisper", "apple", None])} AS suggested_source,
                   {self.pick(d(17, 5), ["settled", "sample", "click_one", "proposal", "full"])} AS grp,
                   {self.pick(d(19, 3), ["A", "B", "C"])} AS tier,
                   {self.pick(d(23, 4), ["advertisement", "immaterial", "reviewer", "judge"])} AS route,
                   {d(29, 90)} AS seconds, {d(31, 4)} = 0 AS opened, status <> 'O' AS decided
            FROM (SELECT o_custkey AS episode_key, o_orderkey AS id, o_orderdate AS at, o_orderstatus AS status, o_orderpriority AS priority,
                         CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM {self.t("orders")}) o)"""

    def turns(self) -> str:
        """Two readings of one span: neighbouring turns of a conversation."""
        return f"""turns AS (
            SELECT conv_id AS episode_key, turn AS id, text AS apple_text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS whisper_text
            FROM {self.t("conversations")})"""


    def known(self, which: str, x: str) -> str:
        """first_value or last_value over what isn't null; a window follows."""
        return self._(f"{which}_value({x}) IGNORE NULLS", f"{which}_value({x} IGNORE NULLS)")


class Duck(Dialect):
    spark = False


def checked(statement: str) -> str:
    """count_if(x) as a count of a CASE: null conditions count for nothing in either engine, and the type is the same."""
    while (at := statement.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(statement[end], 0)
            end += 1
        statement = f"{statement[:at]}count(CASE WHEN {statement[at + 9 : end - 1]} THEN 1 END){statement[end:]}"
    return statement


def sql(name: str) -> Callable:
    """Register a statement, given as a function of the dialect, as a query and as its check."""

    def keep(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        query(name, checked(f(Duck())))(lambda spark, sf_dir: spark.sql(checked(f(Dialect(sf_dir)))))
        return f

    return keep
