"""Pipelines as data: nodes, typed edges and settings, built into DataFrames.

A spec is ``{"name", "settings", "nodes": [{"id", "op", "params"}], "edges": [{"from", "to", "type",
"keys", "port"}]}``. Every node is a function of its inputs; ``port`` orders the inputs of a node with several
(``right``, ``dim``, ``second`` come second) or picks the output of a split.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import inference, joins, keyed, patterns, relational, windows
from millrace.sources import readers, sinks
from millrace.streaming import state

EDGE_TYPES = ("forward", "hash", "rebalance", "broadcast", "rescale")
SOURCES = {"datagen_source", "filesystem_source", "kafka_source", "jdbc_source", "cdc_source", "pulsar_source",
           "kinesis_source", "catalog_table", "values_source", "input"}
SINKS = {"filesystem_sink", "kafka_sink", "cdc_sink", "jdbc_sink", "elasticsearch_sink", "mongodb_sink", "hudi_sink", "iceberg_sink",
         "print_sink", "blackhole_sink", "result_output"}
# parameters that must be present
REQUIRED = {
    "datagen_source": ["fields"], "filesystem_source": ["path"], "kafka_source": ["topic", "bootstrap_servers", "schema"],
    "jdbc_source": ["url", "table"], "catalog_table": ["table"], "input": ["table"], "values_source": ["rows", "columns"],
    "filter": ["condition"], "project": ["columns"], "map_udf": ["function", "inputs", "alias"],
    "udf_node": ["function", "inputs", "alias"], "enrich": ["keys", "columns"], "lookup_join": ["keys", "columns"],
    "union": [], "split": ["routes"], "tumble_window": ["time", "size", "aggs"], "hop_window": ["time", "slide", "size", "aggs"],
    "session_window": ["time", "gap", "by", "aggs"], "cumulate_window": ["time", "step", "max_size", "aggs"],
    "aggregate": ["aggs"], "dedup": ["by", "order"], "topn": ["by", "order", "n"],
    "interval_join": ["keys", "left_time", "right_time", "lower", "upper"],
    "temporal_join": ["keys", "left_time", "right_time"], "regular_join": ["condition"],
    "match_recognize": ["by", "time", "pattern", "define", "within"], "cep_alert": ["time", "size", "by", "aggs", "condition", "severity"],
    "ai_model": ["load", "inputs", "alias"], "feature_store": ["keys", "left_time", "right_time"],
    "watermark_assigner": ["time"], "changelog_normalize": ["by", "order", "mode"], "cdc_source": ["table"],
    "filesystem_sink": ["path"], "kafka_sink": ["topic", "bootstrap_servers"], "cdc_sink": ["keys"],
    "pulsar_source": ["service_url", "topic"], "kinesis_source": ["stream", "region"], "elasticsearch_sink": ["hosts", "index"],
    "mongodb_sink": ["uri", "database", "collection"], "hudi_sink": ["path", "table", "record_key", "precombine"], "iceberg_sink": ["table"],
    "jdbc_sink": ["url", "table"], "print_sink": [], "blackhole_sink": [], "result_output": ["name"],
}


class SpecError(ValueError):
    """The problems of a spec, one per line."""


@dataclass
class Context:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)
    node: str = ""

    @property
    def ttl(self) -> str | None:
        return self.settings.get("ttl")

    def writer(self, df: DataFrame):
        """Writer of a stream with the pipeline's checkpoint and trigger (``available_now`` or an interval)."""
        folder = self.settings.get("checkpoint")
        if not folder:
            raise SpecError(f"{self.node}: a sink of a stream needs the setting 'checkpoint'")
        writer = df.writeStream.outputMode("append").queryName(self.node).option("checkpointLocation", f"{folder}/{self.node}")
        trigger = self.settings.get("trigger") or self.settings.get("mini_batch")
        if trigger == "available_now":
            return writer.trigger(availableNow=True)
        return writer.trigger(processingTime=trigger) if trigger else writer


def _exprs(aggs: dict[str, str]) -> dict:
    return {n: F.expr(e) for n, e in aggs.items()}


def _call(ins, p, ctx):
    call = F.expr(f"{p['function']}({', '.join(p['inputs'])})").alias(p["alias"])
    return ins[0].select(*p.get("passthrough", []), call) if "passthrough" in p else ins[0].withColumn(
        p["alias"], F.expr(f"{p['function']}({', '.join(p['inputs'])})"))


def _watermark(ins, p, ctx):
    from millrace.streaming.watermark import assign
    return assign(ins[0], p["time"], p.get("delay", "5 seconds"), p.get("strategy", "bounded_out_of_order"))


def _lookup(ins, p, ctx):
    if p.get("left_time"):
        right = ins[1].select(*p["keys"], p["right_time"], *p["columns"])
        return _asof([ins[0], right], p, ctx, "left")
    return joins.lookup_join(ins[0], ins[1], p["keys"], p["columns"])


def _aggregate(ins, p, ctx):
    out = ins[0].groupBy(*p.get("by", [])).agg(*[a.alias(n) for n, a in _exprs(p["aggs"]).items()])
    return out.where(p["having"]) if p.get("having") else out


def _sink(fmt: str, options: dict, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable:
    """Sink that one format serves, for tables (appended) and streams."""
    def make(df, ctx):
        rows = shape(df)
        if df.isStreaming:
            writer = ctx.writer(rows).format(fmt).options(**options)
            return lambda: writer.start()
        return lambda: rows.write.mode("append").format(fmt).options(**options).save()
    return make


def _files_sink(ins, p, ctx):
    df, fmt, parts = ins[0], p.get("format", "parquet"), p.get("partition_by", [])
    if df.isStreaming:
        return lambda: ctx.writer(df).format(fmt).partitionBy(*parts).option("path", p["path"]).start()
    return lambda: sinks.write_files(df, p["path"], fmt, parts, mode=p.get("mode", "append"))


def _kafka_sink(ins, p, ctx):
    options = sinks.kafka_sink_options(p["topic"], p["bootstrap_servers"])
    return _sink("kafka", options, lambda df: sinks.encode_messages(df, p.get("keys", []), p.get("format", "json")))(ins[0], ctx)


def _cdc_sink(ins, p, ctx):
    options = sinks.kafka_sink_options(p["topic"], p["bootstrap_servers"])
    return _sink("kafka", options, lambda df: sinks.encode_upserts(df, p["keys"]))(ins[0], ctx)


def _jdbc_sink(ins, p, ctx):
    """Appends; with ``staging`` (a prefix) a table, or each batch of a stream, goes to a staging table of its own, which the function named by
    ``merge`` upserts from."""
    df, own = ins[0], {k: v for k, v in p.items() if k not in ("staging", "merge", "keys")}
    options = readers.jdbc_options(**own)
    if p.get("staging"):
        rest = {k: v for k, v in options.items() if k != "dbtable"}
        write = sinks.jdbc_writer(lambda batch: f"{p['staging']}_{batch}", ctx.functions.get(p.get("merge", "")), **rest)
    else:
        def write(batch, batch_id):
            batch.write.mode("append").format("jdbc").options(**options).save()
    return (lambda: ctx.writer(df).foreachBatch(write).start()) if df.isStreaming else lambda: write(df, "table")


def _table_sink(ins, p, ctx):
    """Appends to a catalog's table, or merges by ``keys``."""
    df = ins[0]
    writer = ctx.writer(df) if df.isStreaming else None
    return lambda: sinks.write_table(df, p["table"], p.get("keys", ()), writer)


def _connector_sink(fmt: str, options: Callable[..., dict]) -> Callable:
    return lambda ins, p, ctx: _sink(fmt, options(**p))(ins[0], ctx)


def _connector_source(fmt: str, options: Callable[..., dict]) -> Callable:
    def read(ins, p, ctx):
        own = {k: v for k, v in p.items() if k != "streaming"}
        reader = ctx.spark.readStream if p.get("streaming", True) else ctx.spark.read
        return reader.format(fmt).options(**options(**own)).load()
    return read


def _blackhole(ins, p, ctx):
    if ins[0].isStreaming:
        return lambda: ctx.writer(ins[0]).format("noop").start()
    return lambda: sinks.blackhole(ins[0])


def _print(ins, p, ctx):
    if ins[0].isStreaming:
        return lambda: ctx.writer(ins[0]).format("console").start()
    return lambda: sinks.console(ins[0])


def _result(ins, p, ctx):
    """A view of a table; of a stream, files and a view over them, so that results do not gather in the driver."""
    if not ins[0].isStreaming:
        return lambda: sinks.result_output(ins[0], p["name"], p.get("limit"))

    node, writer = ctx.node, ctx.writer(ins[0])

    def start():
        query = sinks.result_output(ins[0], p["name"], p.get("limit"), path=f"{ctx.settings['checkpoint']}/{node}-rows", writer=writer)
        if ctx.settings.get("trigger") == "available_now":
            query.awaitTermination()
            query.results()
        return query

    return start


def _time_of(p: dict) -> str:
    return p.get("time") or p["order"][0].lstrip("-")


def _dedup(ins, p, ctx):
    if not ins[0].isStreaming:
        return keyed.dedup(ins[0], p["by"], p["order"], p.get("keep", "first"))
    if p.get("keep", "first") != "first" or p["order"][0].startswith("-"):
        raise SpecError(f"{ctx.node}: on a stream the first row by event time is kept; the last one never is final")
    return state.dedup(ins[0], p["by"], _time_of(p), p.get("ttl", ctx.ttl))


def _topn(ins, p, ctx):
    if not ins[0].isStreaming:
        return keyed.top_n(ins[0], p["by"], p["order"], int(p["n"]))
    if not p.get("time"):
        raise SpecError(f"{ctx.node}: top-N of a stream needs its event time ('time')")
    return state.top_n(ins[0], p["by"], p["time"], p["order"][0], int(p["n"]), p.get("ttl", ctx.ttl))


def _asof(ins, p, ctx, how: str):
    join = state.asof_join if ins[0].isStreaming else joins.asof_join
    return join(ins[0], ins[1], p["keys"], p["left_time"], p["right_time"], how, p.get("ttl", ctx.ttl))


def _match(ins, p, ctx):
    if ins[0].isStreaming:
        return state.match_pattern(ins[0], p["by"], p["time"], p["pattern"], p["define"], p["within"], p.get("skip", "past"))
    return patterns.match_pattern(ins[0], p["by"], p["time"], p["pattern"], p["define"], p["within"], p.get("skip", "past"),
                                  p.get("rows", "one"), p.get("skip_to"))


def _changelog(ins, p, ctx):
    if ins[0].isStreaming:
        return state.changelog(ins[0], p["by"], _time_of(p), p.get("kind", "row_kind"), p["mode"], p.get("ttl", ctx.ttl))
    return keyed.changelog_normalize(ins[0], p["by"], p["order"], p["mode"])


NODES: dict[str, Callable] = {
    "input": lambda ins, p, ctx: ctx.tables[p["table"]],
    "catalog_table": lambda ins, p, ctx: readers.catalog_table(ctx.spark, p["table"], p.get("catalog"), p.get("database")),
    "values_source": lambda ins, p, ctx: readers.values(ctx.spark, [tuple(r) for r in p["rows"]], p["columns"]),
    "datagen_source": lambda ins, p, ctx: readers.datagen(
        ctx.spark, p["fields"], p.get("number_of_rows"), p.get("rows_per_second"), p.get("seed", 1), p.get("time")),
    "filesystem_source": lambda ins, p, ctx: readers.filesystem(
        ctx.spark, p["path"], p.get("format", "parquet"), p.get("schema"), p.get("streaming", False)),
    "kafka_source": lambda ins, p, ctx: readers.kafka(ctx.spark, **p),
    "jdbc_source": lambda ins, p, ctx: readers.jdbc(ctx.spark, **p),
    "cdc_source": lambda ins, p, ctx: keyed.decode_cdc(ctx.tables[p["table"]]),
    "filter": lambda ins, p, ctx: relational.where_all(ins[0], [p["condition"]]),
    "project": lambda ins, p, ctx: relational.project(ins[0], p["columns"]),
    "map_udf": _call,
    "udf_node": _call,
    "enrich": _lookup,
    "lookup_join": _lookup,
    "union": lambda ins, p, ctx: relational.union(ins[0], ins[1], p.get("type", "UNION ALL").upper() == "UNION"),
    "split": lambda ins, p, ctx: relational.split_route(ins[0], p["routes"], p.get("rest")),
    "tumble_window": lambda ins, p, ctx: windows.tumble(ins[0], p["time"], p["size"], p.get("by", []), _exprs(p["aggs"])),
    "hop_window": lambda ins, p, ctx: windows.hop(ins[0], p["time"], p["slide"], p["size"], p.get("by", []), _exprs(p["aggs"])),
    "session_window": lambda ins, p, ctx: windows.session(ins[0], p["time"], p["gap"], p["by"], _exprs(p["aggs"])),
    "cumulate_window": lambda ins, p, ctx: windows.cumulate(
        ins[0], p["time"], p["step"], p["max_size"], p.get("by", []), _exprs(p["aggs"])),
    "aggregate": _aggregate,
    "dedup": _dedup,
    "topn": _topn,
    "interval_join": lambda ins, p, ctx: joins.interval_join(
        ins[0], ins[1], p["keys"], p["left_time"], p["right_time"], p["lower"], p["upper"], p.get("how", "inner").lower()),
    "temporal_join": lambda ins, p, ctx: _asof(ins, p, ctx, p.get("how", "inner").lower()),
    "regular_join": lambda ins, p, ctx: joins.regular_join(
        ins[0].alias("l"), ins[1].alias("r"), F.expr(p["condition"]), p.get("how", "inner").lower().replace(" outer", "")),
    "match_recognize": _match,
    "cep_alert": lambda ins, p, ctx: patterns.keyed_alert(
        ins[0], p["time"], p["size"], p["by"], _exprs(p["aggs"]), p["condition"], p["severity"]),
    "ai_model": lambda ins, p, ctx: inference.score(
        ins[0], ctx.functions[p["load"]], p["inputs"], p["alias"], p.get("passthrough"), returns=p.get("returns", "string")),
    "feature_store": lambda ins, p, ctx: _asof(ins, p, ctx, "left"),
    "watermark_assigner": _watermark,
    "changelog_normalize": _changelog,
    "pulsar_source": _connector_source("pulsar", readers.pulsar_options),
    "kinesis_source": _connector_source("kinesis", readers.kinesis_options),
    "elasticsearch_sink": _connector_sink("org.elasticsearch.spark.sql", sinks.elasticsearch_options),
    "mongodb_sink": _connector_sink("mongodb", sinks.mongodb_options),
    "hudi_sink": lambda ins, p, ctx: _sink("hudi", {**sinks.hudi_options(**{k: v for k, v in p.items() if k != "path"}), "path": p["path"]})(ins[0], ctx),
    "iceberg_sink": _table_sink,
    "filesystem_sink": _files_sink,
    "kafka_sink": _kafka_sink,
    "cdc_sink": _cdc_sink,
    "jdbc_sink": _jdbc_sink,
    "print_sink": _print,
    "blackhole_sink": _blackhole,
    "result_output": _result,
}
_TWO_INPUTS = {"union", "enrich", "lookup_join", "interval_join", "temporal_join", "regular_join", "feature_store"}


@dataclass
class Pipeline:
    name: str
    nodes: list[dict]
    edges: list[dict]
    settings: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict) -> Pipeline:
        return cls(spec.get("name", "untitled"), list(spec["nodes"]), list(spec.get("edges", [])), dict(spec.get("settings", {})))

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "nodes": self.nodes, "edges": self.edges, "settings": self.settings}, indent=2)

    def problems(self) -> list[str]:
        out, ids = [], [n["id"] for n in self.nodes]
        if len(ids) != len(set(ids)):
            out.append("node ids repeat")
        for n in self.nodes:
            op = n["op"]
            if op not in NODES:
                out.append(f"{n['id']}: unknown operator {op!r}")
                continue
            missing = [r for r in REQUIRED.get(op, []) if n.get("params", {}).get(r) in (None, "", [], {})]
            if missing:
                out.append(f"{n['id']}: missing {', '.join(missing)}")
            ins = [e for e in self.edges if e["to"] == n["id"]]
            outs = [e for e in self.edges if e["from"] == n["id"]]
            wanted = 0 if op in SOURCES else 2 if op in _TWO_INPUTS else 1
            if len(ins) != wanted:
                out.append(f"{n['id']}: {len(ins)} inputs instead of {wanted}")
            if not outs and op not in SINKS:
                out.append(f"{n['id']}: no outgoing connection")
        for e in self.edges:
            if e["from"] not in ids or e["to"] not in ids:
                out.append(f"edge {e['from']} -> {e['to']}: unknown node")
            if e.get("type", "forward") not in EDGE_TYPES:
                out.append(f"edge {e['from']} -> {e['to']}: unknown type {e['type']!r}")
        if not out and len(self.order()) < len(ids):
            out.append("the nodes form a cycle")
        return out

    def validate(self) -> Pipeline:
        found = self.problems()
        if found:
            raise SpecError("\n".join(found))
        return self

    def order(self) -> list[str]:
        """Node ids, inputs first; nodes on a cycle are absent."""
        waiting = {n["id"]: {e["from"] for e in self.edges if e["to"] == n["id"]} for n in self.nodes}
        out: list[str] = []
        while ready := [n for n, w in waiting.items() if not w]:
            out += ready
            waiting = {n: w - set(ready) for n, w in waiting.items() if n not in ready}
        return out

    def build(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None,
              functions: dict[str, Callable] | None = None) -> dict[str, object]:
        """Results by node id: a DataFrame, the dict of a split, or for a sink the function that runs it."""
        self.validate()
        ctx = Context(spark, tables or {}, functions or {}, self.settings)
        nodes, done = {n["id"]: n for n in self.nodes}, {}
        for node_id in self.order():
            ins = sorted((e for e in self.edges if e["to"] == node_id),
                         key=lambda e: e.get("port") in ("right", "dim", "second"))
            frames = []
            for e in ins:
                source = done[e["from"]]
                df = source[e["route"]] if isinstance(source, dict) else source
                frames.append(relational.redistribute(df, e.get("type", "forward"), e.get("keys", []), e.get("partitions")))
            ctx.node = node_id
            done[node_id] = NODES[nodes[node_id]["op"]](frames, nodes[node_id].get("params", {}), ctx)
        mode = self.settings.get("mode")
        streams = any(isinstance(d, DataFrame) and d.isStreaming for d in done.values())
        if mode in ("streaming", "batch") and streams != (mode == "streaming"):
            raise SpecError(f"mode {mode!r} is asked for, but the sources are {'streams' if streams else 'tables'}")
        return done

    def run(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None,
            functions: dict[str, Callable] | None = None) -> dict[str, object]:
        """Build and run every sink; streams are started and their queries returned.

        Settings hold while the sinks are run or started, and the session's own come back afterwards: ``conf``, ``parallelism``, ``mode``,
        ``ttl`` (event time after which idle state is forgotten), ``checkpoint`` (folder) and ``trigger`` or ``mini_batch``.
        """
        conf = {k: str(v) for k, v in self.settings.get("conf", {}).items()}
        if self.settings.get("parallelism"):
            conf["spark.sql.shuffle.partitions"] = str(self.settings["parallelism"])
        before = {k: spark.conf.get(k, None) for k in conf}
        for key, value in conf.items():
            spark.conf.set(key, value)
        try:
            built = self.build(spark, tables, functions)
            return {n["id"]: built[n["id"]]() for n in self.nodes if n["op"] in SINKS}
        finally:
            for key, value in before.items():
                spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
