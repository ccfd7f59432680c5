"""Read-only SQL over registered views, with what SQLite has and Spark lacks.

The text is checked with literals, quoted names and comments masked. Spark's
parser then gives its plan, and every node of it is looked at, in subqueries
and common table expressions too: commands and statements that write are
refused, and so are functions that run code and relations other than the given
views and the statement's own names. It runs in a session of its own, where a
division by zero is null, without files, and is always limited by the plan.

SQLite: strftime, date, datetime and time with a moment as epoch seconds
('unixepoch') or text; LIKE without regard to case; CAST AS TEXT; has_attachments
compared with 0 or 1; double-quoted names; `/` of two integers, which is whole;
fractions as floating point; group_concat. Not taken over: bare columns beside aggregates, and GLOB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.predicates import MAX_LIMIT, ToolError

# Words that no read-only statement needs.
FORBIDDEN = "insert update delete drop create alter truncate pragma begin commit rollback vacuum attach detach replace merge".split()
# Functions that run code outside SQL, or read what is no view.
UNSAFE = frozenset("reflect java_method try_reflect read_files python_worker_logs input_file_name".split())
#: Functions that may stand in place of a relation.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/"
MASKED = re.compile(QUOTED, re.S)
#: REPLACE is a function too; as a function it stays allowed.
CALL = re.compile(r"\breplace\s*\(", re.I)
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
MOMENT = "CASE WHEN modifier = 'unixepoch' THEN timestamp_seconds(CAST(moment AS DOUBLE)) WHEN modifier IS NOT NULL THEN raise_error('time modifier not understood') ELSE CAST(moment AS TIMESTAMP) END"
# What SQLite's format letters stand for, as Spark's patterns.
LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
PATTERNS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm:ss", "time": "HH:mm:ss"}


def masked(sql: str) -> str:
    """The text with literals, quoted names and comments blanked."""
    return MASKED.sub(lambda m: {"'": "''", '"': "x", "`": "x"}.get(m[0][0], " "), sql)


def checked(sql: object) -> str:
    """The statement without its last semicolon, or ToolError."""
    text = str(sql or "").strip()
    if not text:
        raise ToolError("sql_query is required")
    bare = masked(text).strip()
    if bare.endswith(";"):
        bare = bare[:-1].rstrip()
        cut = text.rfind(";")
        text = text[:cut] + text[cut + 1 :]
    if ";" in bare:
        raise ToolError("multiple statements not allowed")
    if not re.match(r"\(*\s*(?:select|with)\b", bare, re.I):
        raise ToolError("only SELECT/WITH allowed")
    if set(re.findall(r"\w+", CALL.sub("(", bare).lower())) & (set(FORBIDDEN) | UNSAFE):
        raise ToolError("forbidden keyword detected")
    return text


def translated(sql: str) -> str:
    """SQLite's spelling as Spark's, outside literals and comments."""
    out, place = [], 0

    def plain(text: str) -> str:
        text = re.sub(r"\blike\b", "ILIKE", text, flags=re.I)
        text = re.sub(r"\b(date|datetime|time)\s*\(", r"sqlite_\1(", text, flags=re.I)
        text = re.sub(r"(?<![\w.])(\d+\.\d*|\.\d+)(?![\w.])", r"\1D", text)  # a fraction is no decimal number
        return re.sub(r"((?:\b\w+\.)?\bhas_attachments\b)(?=\s*(?:=|==|!=|<>)\s*[01]\b)", r"CAST(\1 AS INT)", text, flags=re.I)

    for m in MASKED.finditer(sql):
        out.append(plain(sql[place : m.start()]))
        out.append(f"`{m[0][1:-1].replace('`', '``')}`" if m[0][0] == '"' else m[0])
        place = m.end()
    return "".join([*out, plain(sql[place:])])


def closing(bare: str, at: int) -> int:
    """Where the bracket that opens at `at` closes, in a masked text."""
    depth = 0
    for i in range(at, len(bare)):
        depth += (bare[i] == "(") - (bare[i] == ")")
        if not depth:
            return i
    return len(bare)


def blank(sql: str) -> str:
    """The text at its own length, with literals, quoted names and comments as spaces."""
    return MASKED.sub(lambda m: " " * len(m[0]), sql)


def joined_groups(sql: str) -> str:
    """group_concat as string_agg, with a comma where no separator is given."""
    for m in reversed(list(re.finditer(r"\bgroup_concat\s*\(", blank(sql), re.I))):
        bare = blank(sql)
        first, last = m.end() - 1, closing(bare, m.end() - 1)
        inner, depth = bare[first + 1 : last], 0
        alone = True
        for c in inner:
            depth += (c == "(") - (c == ")")
            alone &= not (c == "," and not depth)
        sql = f"{sql[: m.start()]}string_agg({sql[first + 1 : last]}{', ' + chr(39) + ',' + chr(39) if alone else ''}{sql[last:]}"
    return sql


def text_casts(sql: str) -> str:
    """CAST(... AS TEXT) as a cast to string; other uses of the word stay."""
    for m in reversed(list(re.finditer(r"\bcast\s*\(", blank(sql), re.I))):
        bare = blank(sql)
        last = closing(bare, m.end() - 1)
        kind = re.search(r"\bas\s+(text)\s*$", bare[m.end() : last], re.I)
        if kind:
            at = m.end() + kind.start(1)
            sql = f"{sql[:at]}STRING{sql[at + 4 :]}"
    return sql


def each(seq) -> Iterator:
    for i in range(seq.length()):
        yield seq.apply(i)


def is_a(node, kind: str) -> bool:
    loader = node.getClass().getClassLoader()
    return loader is not None and loader.loadClass(kind).isInstance(node)


def inspect_plan(node, visible: frozenset[str]) -> None:
    """Refuse what a read-only statement over the visible names does not hold, at any depth."""
    kind = node.getClass().getSimpleName()
    if is_a(node, f"{LOGICAL}.Command") or is_a(node, f"{LOGICAL}.ParsedStatement"):
        raise ToolError("forbidden keyword detected")
    if kind == "UnresolvedRelation":
        parts = list(each(node.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in visible:
            raise ToolError(f"no such table: {'.'.join(parts)}")
    elif kind == "UnresolvedFunction" and {p.lower() for p in each(node.nameParts())} & UNSAFE:
        raise ToolError("forbidden keyword detected")
    elif kind == "UnresolvedTableValuedFunction" and list(each(node.name()))[-1].lower() not in TABLE_FUNCTIONS:
        raise ToolError(f"no such table: {list(each(node.name()))[-1]}")
    elif "UnresolvedIdentifier" in kind:
        raise ToolError("forbidden keyword detected")
    inner = list(each(node.innerChildren()))
    if kind == "UnresolvedWith":  # its names are seen inside it only
        visible = visible | {x.alias().lower() for x in inner}
    below = [*each(node.children()), *inner]
    if is_a(node, f"{LOGICAL}.LogicalPlan"):
        below += each(node.expressions())
    elif is_a(node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        below.append(node.plan())
    for x in below:
        if is_a(x, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            inspect_plan(x, visible)


INTEGRAL = frozenset("byte short integer long".split())


def whole(e, user_cast) -> bool:
    """Whether an operand is an integer that Spark itself made a fraction of."""
    return e.getClass().getSimpleName() == "Cast" and e.child().dataType().typeName() in INTEGRAL and e.getTagValue(user_cast).isEmpty()


def divisions(node, user_cast) -> Iterator[tuple[int, int]]:
    """Where the text has divisions of two integers, from an analysed plan."""
    if node.getClass().getSimpleName() == "Divide" and whole(node.left(), user_cast) and whole(node.right(), user_cast):
        where = node.origin()
        if where.startIndex().isDefined() and where.stopIndex().isDefined():
            yield where.startIndex().get(), where.stopIndex().get()
    below = [*each(node.children()), *each(node.innerChildren())]
    if is_a(node, f"{LOGICAL}.LogicalPlan"):
        below += each(node.expressions())
    elif is_a(node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        below.append(node.plan())
    for x in below:
        if is_a(x, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            yield from divisions(x, user_cast)


def whole_divisions(own, sql: str) -> str:
    """The statement with `div` for each division of two integers: the last sign outside brackets in its span."""
    user_cast = own._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    for _ in range(blank(sql).count("/")):
        bare, signs = blank(sql), set()
        for first, last in divisions(own._jsparkSession.sql(sql).queryExecution().analyzed(), user_cast):
            depth, sign = 0, None
            for i in range(first, last + 1):
                depth += (bare[i] == "(") - (bare[i] == ")")
                if bare[i] == "/" and not depth:
                    sign = i
            if sign is not None:
                signs.add(sign)
        if not signs:
            break
        for i in sorted(signs, reverse=True):
            sql = f"{sql[:i]} div {sql[i + 1 :]}"
    return sql


def functions(session) -> None:
    """SQLite's time functions, in this session."""
    text = "replace(form, '%%', chr(1))"
    for letter, pattern in LETTERS.items():
        text = f"replace({text}, '{letter}', date_format({MOMENT}, '{pattern}'))"
    text = f"replace({text}, '%w', CAST(dayofweek({MOMENT}) - 1 AS STRING))"
    text = f"replace(replace({text}, '%s', CAST(unix_seconds({MOMENT}) AS STRING)), chr(1), '%')"
    text = f"CASE WHEN regexp_like(replace(form, '%%', ''), '%([^YmdHMSjws]|$)') THEN raise_error('format letter not understood') ELSE {text} END"
    session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strftime(form STRING, moment STRING, modifier STRING DEFAULT NULL) RETURNS STRING RETURN {text}")
    for name, pattern in PATTERNS.items():
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sqlite_{name}(moment STRING, modifier STRING DEFAULT NULL) RETURNS STRING RETURN date_format({MOMENT}, '{pattern}')")


def execute_sql_query(views: dict[str, DataFrame], sql_query: object, most: int = MAX_LIMIT) -> DataFrame:
    """Rows of a guarded statement over the views, at most `most`."""
    text = text_casts(joined_groups(translated(checked(sql_query))))
    own = next(iter(views.values())).sparkSession.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.ansi.enabled", "false")
    try:
        plan = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ToolError(f"SQL error: {str(e).splitlines()[0]}") from e
    inspect_plan(plan, frozenset(v.lower() for v in views))
    functions(own)
    for name, df in views.items():
        _register(own._jsparkSession, df, name)
    return own.sql(whole_divisions(own, text)).limit(most)


def _register(session, df: DataFrame, name: str) -> None:
    """A temporary view of df's plan in another session."""
    jvm = df.sparkSession._jvm
    jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
