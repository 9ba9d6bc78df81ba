"""Conversation logs of several formats as messages: session, pos, role, text, tools. sessions.turns() pairs them.

Each reader takes lines (session, pos, value: one JSON record a line); what is no message is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from tessera.functions.text import first_text

BLOCKS = "array<struct<type:string,text:string,name:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, pos, value) of files of lines; the session is the file's name."""
    lines = spark.read.text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(name.alias("session"), F.monotonically_increasing_id().alias("pos"), "value").where(F.trim("value") != "")


def _at(path: str) -> Column:
    return F.get_json_object("value", path)


def blocks_text(content: Column, kinds: tuple[str, ...] = ("text", "input_text", "output_text")) -> Column:
    """Text of a content that is a string or a list of blocks; blocks of other kinds are left out."""
    listed = F.from_json(content, BLOCKS)
    texts = F.transform(F.filter(listed, lambda b: b["type"].isin(*kinds) & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.trim(content).startswith("[") & listed.isNotNull(), F.array_join(texts, "\n")).otherwise(content)


def blocks_tools(content: Column) -> Column:
    listed = F.from_json(content, BLOCKS)
    names = F.transform(F.filter(listed, lambda b: b["type"] == "tool_use"), lambda b: F.coalesce(b["name"], F.lit("unknown")))
    return F.when(F.trim(content).startswith("["), names)


def _messages(lines: DataFrame, role: Column, text: Column, tools: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    found = lines.select("session", "pos", role.alias("role"), text.alias("text"), F.coalesce(tools, none).alias("tools"))
    return found.where(F.col("role").isin("user", "assistant"))


def nested(lines: DataFrame) -> DataFrame:
    """{type or role, message: {role, content}}: content is a string, or blocks of text and tool_use."""
    role = F.coalesce(_at("$.message.role"), _at("$.role"), _at("$.type"))
    content = _at("$.message.content")
    return _messages(lines.where(content.isNotNull()), role, blocks_text(content), blocks_tools(content))


def rollout(lines: DataFrame) -> DataFrame:
    """{type: response_item, payload: {type: message or function_call, ...}}."""
    item = lines.where(_at("$.type") == "response_item")
    call = _at("$.payload.type") == "function_call"
    role = F.when(call, "assistant").when(_at("$.payload.type") == "message", _at("$.payload.role"))
    return _messages(item, role, F.when(~call, blocks_text(_at("$.payload.content"))), F.when(call, F.array(_at("$.payload.name"))))


def typed(lines: DataFrame) -> DataFrame:
    """{type: user, assistant, system, reasoning or tool_result, content, tool_calls}: the last three kinds are left out."""
    calls = F.transform(F.from_json(_at("$.tool_calls"), "array<struct<name:string>>"), lambda c: c["name"])
    return _messages(lines, _at("$.type"), blocks_text(_at("$.content")), calls)


def dotted(lines: DataFrame) -> DataFrame:
    """{type: user.message, assistant.message or tool.execution_start, data: {content or toolName}}."""
    kind = _at("$.type")
    role = F.when(kind == "user.message", "user").when(kind.isin("assistant.message", "tool.execution_start"), "assistant")
    return _messages(lines, role, _at("$.data.content"), F.when(kind == "tool.execution_start", F.array(F.coalesce(_at("$.data.toolName"), F.lit("unknown")))))


#: Names of roles.
ROLES = {"user": ("user", "human"), "assistant": ("assistant", "ai", "model")}


def plain(lines: DataFrame) -> DataFrame:
    """{role or type, content or text or message}: with synonyms of roles; rows marked as meta or automated are left out."""
    name = F.lower(F.coalesce(_at("$.role"), _at("$.message.role"), _at("$.type")))
    role = F.when(name.isin(*ROLES["user"]), "user").when(name.isin(*ROLES["assistant"]), "assistant")
    content = F.coalesce(_at("$.message.content"), _at("$.content"), _at("$.text"), _at("$.message"))
    automated = F.coalesce(_at("$.isMeta"), _at("$.automated"), F.lit("false")) == "true"
    return _messages(lines.where(~automated), role, blocks_text(content), blocks_tools(content))


FORMATS = {"nested": nested, "rollout": rollout, "typed": typed, "dotted": dotted, "plain": plain}


def without_tags(text: Column) -> Column:
    """A user's text without the command tags that clients put around it."""
    return F.trim(F.regexp_replace(text, r"(?s)<(command-[a-z]+|local-command-[a-z]+|system-reminder)>.*?</\1>", ""))


def bubbles(rows: DataFrame) -> DataFrame:
    """Messages of conversations kept as one JSON document each (session, value): a map of bubbles with text, type and time."""
    m = F.from_json(_at("$.conversationMap"), "map<string,struct<type:string,role:string,text:string,createdAt:bigint>>")
    each = rows.select("session", F.explode(m).alias("bubble", "b"))
    role = F.when(F.col("b.role").isNotNull(), F.col("b.role")).when(F.col("b.type").isin("1", "user"), "user").when(F.col("b.type").isin("2", "ai", "assistant"), "assistant")
    order = F.struct(F.coalesce("b.createdAt", F.lit(0)).alias("t"), F.coalesce(F.try_to_number("bubble", F.lit("999999999999")).cast("long"), F.lit(0)).alias("n"), F.col("bubble").alias("id"))
    return each.select("session", order.alias("pos"), role.alias("role"), first_text(F.col("b.text")).alias("text"), F.array().cast("array<string>").alias("tools")).where("role is not null")


def newest(files: DataFrame, cwd: str | None = None) -> DataFrame:
    """The file (path, mtime, cwd) to import: the newest of the working directory, else the newest of all; ties by path."""
    match = F.lit(True) if cwd is None else F.coalesce(F.col("cwd") == cwd, F.lit(False))
    return files.agg(F.max_by("path", F.struct(match, "mtime", "path")).alias("path"))


def first_record_cwd(lines: DataFrame) -> DataFrame:
    """(path, cwd): the working directory that the first record of a file (path, pos, value) names, if it is the session's own."""
    first = lines.groupBy("path").agg(F.min_by("value", "pos").alias("value"))
    return first.select("path", F.when(_at("$.type") == "session_meta", _at("$.payload.cwd")).alias("cwd"))


def early_cwd(lines: DataFrame, first: int = 64) -> DataFrame:
    """(path, cwd): the first working directory that one of the first lines of a file (path, pos from 0, value) names."""
    named = F.coalesce(F.nullif(_at("$.cwd"), F.lit("")), F.nullif(_at("$.data.cwd"), F.lit("")))
    return lines.where(F.col("pos") < first).groupBy("path").agg(F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("cwd"))


def session_of(files: DataFrame, recorded: DataFrame, cwd: str | None, fallback: bool = True) -> DataFrame:
    """The newest file (path, mtime) whose recorded directory (path, cwd) is cwd; else the newest of all, or none without fallback."""
    found = files.join(recorded, "path", "left")
    if not fallback:
        found = found.where(F.col("cwd") == cwd)
    return newest(found, cwd).where("path is not null")


#: Ends of the names of files that lie beside transcripts; names of a session's files.
SIDECARS = (".checkpoints.jsonl", ".prompts.jsonl", ".share.jsonl")
SUMMARY, CHAT = "summary.json", "chat_history.jsonl"


def project_slug(cwd: str) -> str:
    """The name of the folder that keeps a working directory's sessions: slashes and underscores become dashes."""
    return "-" + cwd.lstrip("/").translate(str.maketrans("/_", "--"))


def url_name(cwd: str) -> str:
    """The same for clients that quote the directory as in a URL."""
    return quote(cwd, safe="")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def project_transcripts(files: DataFrame, root: str, name: str) -> DataFrame:
    """The transcripts (path, mtime) that lie in a project's own folder below root, those in folders of it left out."""
    return files.where((_parent(F.col("path")) == f"{root.rstrip('/')}/{name}") & F.col("path").endswith(".jsonl"))


def session_folders(files: DataFrame, root: str, name: str) -> DataFrame:
    """(path, mtime) of the session folders in a project's folder: those with a chat history, at the time of their summary or else of their history."""
    inside = files.withColumns({"folder": _parent(F.col("path")), "file": F.element_at(F.split("path", "/"), -1)})
    inside = inside.where((_parent(F.col("folder")) == f"{root.rstrip('/')}/{name}") & F.col("file").isin(SUMMARY, CHAT))
    time_of = lambda file: F.max(F.when(F.col("file") == file, F.col("mtime")))
    each = inside.groupBy(F.col("folder").alias("path")).agg(time_of(SUMMARY).alias("summary"), time_of(CHAT).alias("chat"))
    return each.where("chat is not null").select("path", F.coalesce("summary", "chat").alias("mtime"))


def main_transcripts(files: DataFrame) -> DataFrame:
    """The transcripts (path, mtime) without the files beside them."""
    beside = F.lit(False)
    for end in SIDECARS:
        beside = beside | F.col("path").endswith(end)
    return files.where(F.col("path").endswith(".jsonl") & ~beside)


# ---------------------------------------------------------------- conversations in a key-value table


def composers(rows: DataFrame, prefix: str = "composerData:") -> DataFrame:
    """(session, created, value) of rows (key, value) of a key-value table: values that are JSON objects, under the prefix, and hold
    a conversation or a text. Others are left out; callers sort by created, newest first."""
    doc = rows.where(F.col("key").startswith(prefix)).select("value").where(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull())
    talk, text = F.coalesce(_at("$.conversationMap"), F.lit("{}")), F.coalesce(_at("$.text"), F.lit(""))
    full = doc.where(~F.regexp_replace(talk, r"\s", "").isin("{}", "null", "[]") | (text != ""))
    return full.select(F.coalesce(_at("$.composerId"), F.lit("unknown")).alias("session"), F.coalesce(_at("$.createdAt").cast("long"), F.lit(0)).alias("created"), "value")


def conversation_hash(value: Column) -> Column:
    """sha256 over a conversation's id, messages and text as JSON with sorted keys, so that the order of keys doesn't matter."""
    doc = F.try_parse_json(value)
    part = lambda path: F.coalesce(F.to_json(F.try_variant_get(doc, path, "variant")), F.lit("null"))
    return F.sha2(F.concat_ws("\n", part("$.composerId"), part("$.conversationMap"), part("$.text")), 256)


# ---------------------------------------------------------------- SQLite


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.columns = int(options.get("partitions", "4")), schema.names
        self.conditions: list[str] = []
        self.values: list = []
        if not all(c.replace("_", "").isalnum() for c in [self.table, *self.columns]):
            raise ValueError("names of tables and columns hold letters, digits and _ only")

    def _rows(self, sql: str, args: tuple = ()):
        import sqlite3

        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(sql, args)
        finally:
            con.close()

    def partitions(self) -> list[_Part]:
        low, high = next(self._rows(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}"))
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Part(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.conditions])
        yield from self._rows(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE {where}", (partition.low, partition.high, *self.values))


_RANGES = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _PushingReader(_Reader):
    """Reads only rows that may pass: texts by equality, list, range and prefix, whole numbers by equality, list and range.

    Values are parameters, never text of the statement. A condition is handed on only where SQLite can't be stricter than Spark: the
    column's declared type must be of the schema's kind. Spark judges all conditions again."""

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        declared = {r[1]: r[2].upper() for r in self._rows(f"PRAGMA table_info({self.table})")}
        self.kinds: dict[str, type] = {}
        for f in schema.fields:
            if isinstance(f.dataType, T.StringType) and any(k in declared.get(f.name, "") for k in ("CHAR", "TEXT", "CLOB")):
                self.kinds[f.name] = str
            elif isinstance(f.dataType, T.IntegralType) and "INT" in declared.get(f.name, ""):
                self.kinds[f.name] = int

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            kind = self.kinds.get(column)
            if kind is not None:
                self._push(f, column, kind)
            yield f

    def _push(self, f: Filter, column: str, kind: type) -> None:
        exact = f"{column} COLLATE BINARY" if kind is str else column
        values = f.value if isinstance(f, In) else (f.value,) if hasattr(f, "value") else ()
        if any(type(v) is not kind for v in values):
            return
        if isinstance(f, EqualTo):
            self._add(f"{exact} = ?", *values)
        elif isinstance(f, In) and 0 < len(values) <= 500:
            self._add(f"{exact} IN ({', '.join('?' * len(values))})", *values)
        elif type(f) in _RANGES:
            self._add(f"{exact} {_RANGES[type(f)]} ?", *values)
        elif isinstance(f, StringStartsWith) and f.value:
            self._add(f"{exact} >= ?", f.value)
            if (end := after_prefix(f.value)) is not None:
                self._add(f"{exact} < ?", end)

    def _add(self, condition: str, *values) -> None:
        self.conditions.append(condition)
        self.values.extend(values)


def after_prefix(prefix: str) -> str | None:
    """The least text, by code points, above all that begin with prefix; None if there is none."""
    kept = prefix.rstrip(chr(0x10FFFF))
    if not kept:
        return None
    last = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if last == 0xD800 else last)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    """A table of an SQLite file; conditions on it reach SQLite, so its indexes serve them. Turns on the session's push-down to Python sources."""
    spark.dataSource.register(SQLiteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).option("push", "true").load()


class SQLiteSource(DataSource):
    """spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...).load(): read by ranges of rowid.

    The file must be readable where the tasks run. With option("push", "true") conditions are handed to SQLite, which needs
    spark.sql.python.filterPushdown.enabled; read_sqlite() sets both."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self):
        raise ValueError("give a schema")

    def reader(self, schema) -> _Reader:
        push = self.options.get("push", "false").lower() == "true"
        return (_PushingReader if push else _Reader)(self.options, schema)


def current_session(sessions: DataFrame, projects: DataFrame, worktree: str) -> DataFrame:
    """The session of a project's worktree that was updated last."""
    own = projects.where(F.col("worktree") == worktree).select(F.col("id").alias("project_id"))
    return sessions.join(own, "project_id", "left_semi").orderBy(F.desc("time_updated"), F.desc("id")).limit(1)


def relational(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of a message table and a part table, whose data is JSON: role with the message, text and tools with its parts."""
    kind, text = F.get_json_object("p.data", "$.type"), F.get_json_object("p.data", "$.text")
    each = messages.alias("m").join(parts.alias("p"), F.col("m.id") == F.col("p.message_id"))
    row = F.struct(F.col("p.time_created").alias("t"), F.col("p.id").alias("id"), F.when(kind == "text", text).alias("text"), F.when(kind == "tool", F.get_json_object("p.data", "$.tool")).alias("tool"))
    g = each.groupBy(F.col("m.session_id").alias("session"), F.struct(F.col("m.time_created").alias("t"), F.col("m.id").alias("id")).alias("pos"), F.get_json_object("m.data", "$.role").alias("role")).agg(F.array_sort(F.collect_list(row)).alias("ps"))
    pick = lambda name: F.filter(F.transform("ps", lambda x: x[name]), lambda x: x.isNotNull())
    return g.select("session", "pos", "role", F.array_join(pick("text"), "\n").alias("text"), pick("tool").alias("tools"))


def qa_questions(samples: DataFrame) -> DataFrame:
    """(sample_id, no, question, category, gold) of QA samples (sample_id, qa array<struct<question, answer, adversarial_answer, category>>): category 5 is adversarial."""
    gold = F.when(F.col("q.category") == 5, F.coalesce("q.adversarial_answer", F.lit(""))).otherwise(F.coalesce("q.answer", F.lit("")))
    return samples.select("sample_id", F.posexplode("qa").alias("no", "q")).select("sample_id", "no", "q.question", "q.category", gold.alias("gold"))
