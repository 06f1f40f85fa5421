"""One statement, rendered for Spark SQL and for DuckDB.

``@name(arguments)`` is replaced by what the engine calls it; arguments may nest.
"""

from __future__ import annotations

RULES = {
    "epoch": ("unix_timestamp({0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "json_int": ("CAST(get_json_object({0}, '$.{1}') AS INT)", "CAST(json_extract_string({0}, '$.{1}') AS INT)"),
    "div": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "listagg": ("listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})", "string_agg({0}, {1} ORDER BY {2})"),
    "series": ("SELECT explode(sequence({0}, {1})) AS {2}", "SELECT unnest(generate_series({0}, {1})) AS {2}"),
    "rlike": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "extract": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "sub": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "even": ("CAST(bround({0}) AS INT)", "CAST(round_even({0}, 0) AS INT)"),
    "part": ("element_at(split({0}, '[.]'), {1})", "string_split({0}, '.')[{1}]"),
    "split": ("split({0}, {1})", "string_split({0}, {1})"),
    "unnest": ("explode({0})", "unnest({0})"),
    "size": ("size({0})", "len({0})"),
    "raw": ("r'{0}'", "'{0}'"),
    "and": ("({0} & {1})", "({0} & {1})"),
    "day": ("date_format(timestamp_seconds({0}), 'yyyy-MM-dd HH:mm')", "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d %H:%M')"),
    "endswith": ("endswith({0}, {1})", "ends_with({0}, {1})"),
    "bool_or": ("bool_or({0})", "bool_or({0})"),
    "recursive": ("WITH RECURSIVE", "WITH RECURSIVE"),
}


def render(sql: str, duck: bool) -> str:
    out, at = [], 0
    while (i := sql.find("@", at)) >= 0:
        j = sql.find("(", i)
        name = sql[i + 1 : j]
        if name not in RULES:
            out.append(sql[at : i + 1])
            at = i + 1
            continue
        depth, quoted, start, args, k = 1, False, j + 1, [], j + 1
        while depth:
            c = sql[k]
            if c == "'":
                quoted = not quoted
            elif not quoted and c in "([":
                depth += 1
            elif not quoted and c in ")]":
                depth -= 1
            if not depth or (c == "," and depth == 1 and not quoted):
                args.append(sql[start:k].strip())
                start = k + 1
            k += 1
        args = [render(a, duck) for a in args]
        if name == "raw":
            args = [a.strip("'") for a in args]
        out.append(sql[at:i] + RULES[name][duck].format(*args))
        at = k
    return "".join(out) + sql[at:]
