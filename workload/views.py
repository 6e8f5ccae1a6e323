"""Inputs of the registered queries, derived from the given tables in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.episodes import conversations_to_episodes
from chronoweave.operators.ordered import joined_in_order
from chronoweave.session import configure, spread

EPOCH = "2024-01-01 00:00:00"


def minutes_after_epoch(n):
    return F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + n.cast("long") * 60)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def t(self, name: str) -> DataFrame:
        """A given table; zone-less times become instants in UTC."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        times = {
            f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)
        }
        df = df.withColumns(times) if times else df
        return spread(df) if name == "documents" else df

    # --- episodes
    def msg_ep(self) -> DataFrame:
        ep = conversations_to_episodes(self.t("conversations"))
        return ep.select(
            F.concat(F.lit("conv-"), F.col("conv_id")).alias("uuid"),
            F.lit("conversation").alias("name"),
            "content",
            "source",
            F.lit("chat").alias("source_description"),
            F.concat(F.lit("g"), F.col("n_turns")).alias("group_id"),
            minutes_after_epoch(F.col("conv_id")).alias("reference_time"),
            minutes_after_epoch(F.col("conv_id")).alias("created_at"),
        )

    def json_ep(self) -> DataFrame:
        return self.t("events").select(
            F.concat(F.lit("ev-"), F.col("event_id")).alias("uuid"),
            F.col("event_type").alias("name"),
            F.col("props").alias("content"),
            F.lit("json").alias("source"),
            F.lit("event log").alias("source_description"),
            F.col("user_id").cast("string").alias("group_id"),
            F.col("ts").alias("reference_time"),
            F.col("ts").alias("created_at"),
        )

    def messy_ep(self) -> DataFrame:
        """Raw episodes with every case of the normalisation, by event type."""
        kind = F.col("event_type")
        null = F.lit(None).cast("string")
        source = (
            F.when(kind == "view", "JSON").when(kind == "click", "Message").when(kind == "purchase", "csv")
            .when(kind == "signup", "text")
        )
        return self.t("events").select(
            F.when(kind != "click", F.concat(F.lit("ev-"), F.col("event_id"))).alias("uuid"),
            kind.alias("name"),
            F.concat(F.lit("event "), F.col("event_id"), F.lit(" "), F.col("props")).alias("content"),
            source.alias("source"),
            F.when(kind == "view", null).otherwise(F.lit("log")).alias("source_description"),
            F.when(kind == "error", null).when(kind == "signup", "").otherwise(F.col("user_id").cast("string")).alias("group_id"),
            F.when(kind != "purchase", F.col("ts")).alias("reference_time"),
        )

    def text_ep(self) -> DataFrame:
        kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
        say = lambda template: F.replace(F.lit(template), F.lit("{k}"), k)
        content = (
            F.when(kind == "purchase", say("I like item {k}. I prefer item {k} over basic."))
            .when(kind == "view", say("I don't like item {k}."))
            .when(kind == "error", say("We need fix {k}. Fix {k} is required."))
            .when(kind == "click", say("First do {k}, then do ship."))
            .otherwise("If signup occurs, then do welcome.")
        )
        return self.json_ep_with(content, "text")

    def struct_ep(self) -> DataFrame:
        kind = F.col("event_type")
        full = lambda quote: F.concat(
            F.lit('{"name": "u'), F.col("user_id"), F.lit('", "type": "'), kind, F.lit(f'", "confidence": {quote}'),
            F.col("value").cast("string"), F.lit(f"{quote}}}"),
        )
        content = (
            F.when(kind == "purchase", full("")).when(kind == "signup", full('"')).when(kind == "view", F.col("props"))
            .when(kind == "click", F.concat(F.lit("text "), F.col("props"))).otherwise('{"invalid": json')
        )
        return self.json_ep_with(content, "json")

    def list_ep(self) -> DataFrame:
        kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
        one = lambda key: F.concat(F.lit('{"entity_type_id": '), k, F.lit(f', "{key}": "'), kind, F.lit('"}'))
        bare = F.concat(F.lit("["), one("entity"), F.lit(", "), one("name"), F.lit("]"))
        wrapped = F.concat(F.lit('{"extracted_entities": ['), one("name"), F.lit("]}"))
        content = (
            F.when(kind.isin("view", "click"), bare).when(kind == "purchase", wrapped).when(kind == "error", "[]")
            .otherwise('{"bad"')
        )
        return self.json_ep_with(content, "json")

    def json_ep_with(self, content, source: str) -> DataFrame:
        return self.t("events").select(
            F.concat(F.lit("ev-"), F.col("event_id")).alias("uuid"),
            F.col("event_type").alias("name"),
            content.alias("content"),
            F.lit(source).alias("source"),
            F.lit("").alias("source_description"),
            F.col("user_id").cast("string").alias("group_id"),
            F.col("ts").alias("reference_time"),
            F.col("ts").alias("created_at"),
        )

    def statements(self) -> DataFrame:
        """One statement per event, each rule at least once; (user_id, event_id, role, text)."""
        kind, k, odd = F.col("event_type"), F.get_json_object("props", "$.k"), F.col("event_id") % 2 == 1
        say = lambda template: F.replace(F.lit(template), F.lit("{k}"), k)
        text = (
            F.when(kind == "purchase", F.when(odd, say("I love album {k}")).otherwise(say("I prefer tea {k} over basic")))
            .when(kind == "view", F.when(odd, say("I hate label {k}")).otherwise(say("I don't like song {k}")))
            .when(kind == "error", F.when(odd, say("Audit {k} is required")).otherwise(say("We need critical fix {k}")))
            .when(kind == "click", F.when(odd, say("Always check {k} when rain happens")).otherwise(say("First do {k}, then do ship")))
            .otherwise(F.when(odd, say("Login {k} must have high priority check")).otherwise(say("If signup occurs, then do welcome {k}")))
        )
        role = F.when(F.col("event_id") % 3 == 0, "assistant").otherwise("user")
        return self.t("events").select("user_id", "event_id", role.alias("role"), text.alias("text"))

    def _told(self, df: DataFrame, prefix: str, source: str) -> DataFrame:
        at = minutes_after_epoch(F.col("user_id"))
        return df.select(
            F.concat(F.lit(prefix), F.col("user_id")).alias("uuid"), F.lit(prefix.rstrip("-")).alias("name"), "content",
            F.lit(source).alias("source"), F.lit("").alias("source_description"),
            F.col("user_id").cast("string").alias("group_id"), at.alias("reference_time"), at.alias("created_at"),
        )

    def chat_ep(self) -> DataFrame:
        """A chat per user, a statement per turn."""
        chats = conversations_to_episodes(self.statements(), "user_id", "event_id", "role", "text")
        return self._told(chats, "chat-", "message")

    def line_ep(self) -> DataFrame:
        """A note per user, a statement per line, without end marks and some as list items."""
        line = F.concat(F.when(F.col("event_id") % 5 == 0, "- ").otherwise(""), F.col("text"))
        notes = joined_in_order(self.statements(), ["user_id"], "event_id", line, "\n", "content")
        return self._told(notes, "note-", "text")

    def deep_ep(self, table: str = "orders", depth: int = 8) -> DataFrame:
        """Rows of orders or customer as objects nested `depth` deep."""
        key, group, date = {
            "orders": ("o_orderkey", F.col("o_orderstatus"), F.col("o_orderdate")),
            "customer": ("c_custkey", F.col("c_mktsegment"), F.lit("2024-01-01").cast("timestamp")),
        }[table]
        body = F.concat(F.lit(f'{{"name": "n{depth}", "key": '), F.col(key).cast("string"), F.lit("}"))
        for level in range(depth - 1, -1, -1):
            body = F.concat(F.lit(f'{{"name": "n{level}", "in{level + 1}": '), body, F.lit("}"))
        return spread(self.t(table)).select(
            F.concat(F.lit("o-"), F.col(key)).alias("uuid"), F.lit("order").alias("name"), body.alias("content"),
            F.lit("json").alias("source"), F.lit("").alias("source_description"), group.alias("group_id"),
            date.alias("reference_time"), date.alias("created_at"),
        )

    # --- nodes, queries
    def node(self) -> DataFrame:
        emb = self.t("embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("name_embedding"))
        return (
            self.t("part")
            .join(emb, "p_partkey", "left")
            .select(
                F.col("p_partkey").cast("string").alias("uuid"),
                F.col("p_name").alias("name"),
                F.concat_ws(" ", "p_type", "p_brand").alias("summary"),
                F.array("p_type").alias("labels"),
                F.col("p_brand").alias("group_id"),
                minutes_after_epoch(F.col("p_partkey")).alias("created_at"),
                F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
                "name_embedding",
            )
        )

    def query(self) -> DataFrame:
        """One query per nation: the part of that number, by name and by vector."""
        part = self.t("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
        emb = self.t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        nation = self.t("nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
        return nation.join(part, "query_id").join(emb, "query_id").select("query_id", "text", "embedding")

    # --- the customer, supplier, nation, region graph
    def ent(self) -> DataFrame:
        def kind(table: str, p: str, key: str, name: str, summary) -> DataFrame:
            return self.t(table).select(
                F.concat(F.lit(f"{p}:"), F.col(key)).alias("uuid"),
                F.col(name).alias("name"),
                summary.alias("summary"),
                F.array(F.lit(table.capitalize())).alias("labels"),
                F.lit(table).alias("group_id"),
                F.col(key).cast("long").alias("vec_id"),
            )

        emb = self.t("embeddings").select("vec_id", F.col("embedding").alias("name_embedding"))
        whole = (
            kind("customer", "c", "c_custkey", "c_name", F.concat(F.lit("buys "), F.col("c_mktsegment")))
            .unionByName(kind("supplier", "s", "s_suppkey", "s_name", F.lit("sells parts")))
            .unionByName(kind("nation", "n", "n_nationkey", "n_name", F.lit("a nation")))
            .unionByName(kind("region", "r", "r_regionkey", "r_name", F.lit("a region")))
        )
        return whole.join(emb, "vec_id", "left").select(
            "uuid", "name", "summary", "labels", "group_id",
            minutes_after_epoch(F.col("vec_id")).alias("created_at"),
            F.create_map(F.lit("key"), F.col("vec_id").cast("string")).alias("attributes"),
            "name_embedding",
        )

    def edge(self) -> DataFrame:
        nation = self.t("nation")
        region = self.t("region")

        def rows(df: DataFrame, sp: str, key: str, sname: str, name: str, tp: str, tkey: str, tname: str) -> DataFrame:
            verb = name.replace("_", " ")
            return df.select(
                F.concat(F.lit(f"{sp}:"), F.col(key), F.lit(f">{name}")).alias("uuid"),
                F.concat(F.lit(f"{sp}:"), F.col(key)).alias("source_node_uuid"),
                F.concat(F.lit(f"{tp}:"), F.col(tkey)).alias("target_node_uuid"),
                F.lit(name).alias("name"),
                F.concat(F.col(sname), F.lit(f" {verb} "), F.col(tname)).alias("fact"),
                F.col(key).cast("long").alias("k"),
                F.lit(name == "lives_in").alias("with_vector"),
            )

        whole = (
            rows(self.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
                 "c", "c_custkey", "c_name", "lives_in", "n", "n_nationkey", "n_name")
            .unionByName(rows(self.t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
                              "s", "s_suppkey", "s_name", "based_in", "n", "n_nationkey", "n_name"))
            .unionByName(rows(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")),
                              "n", "n_nationkey", "n_name", "part_of", "r", "r_regionkey", "r_name"))
        )
        emb = self.t("embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("fact_embedding"))
        at = minutes_after_epoch(F.col("k"))
        none = F.lit(None).cast("timestamp")
        return (
            whole.join(emb.withColumn("with_vector", F.lit(True)), ["k", "with_vector"], "left")
            .select(
                "uuid", F.col("name").alias("group_id"), "source_node_uuid", "target_node_uuid", "name", "fact",
                "fact_embedding", F.array(F.concat(F.lit("ep-"), F.col("k"))).alias("episodes"),
                (at + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
                none.alias("expired_at"), at.alias("valid_at"), none.alias("invalid_at"),
                F.create_map(F.lit("fact_embedding"), F.lit("0"), F.lit("key"), F.col("k").cast("string")).alias("attributes"),
            )
        )

    def fact(self) -> DataFrame:
        return self.t("events").select(
            F.concat(F.lit("ev-"), F.col("event_id")).alias("uuid"),
            F.lit("g").alias("group_id"),
            F.col("user_id").cast("string").alias("source_node_uuid"),
            F.concat(F.lit("b"), F.floor(F.col("value") / 50).cast("string")).alias("target_node_uuid"),
            F.col("event_type").alias("name"),
            F.concat_ws(" ", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")).alias("fact"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
            F.col("ts").alias("valid_at"),
        )

    # --- other inputs
    def layers(self) -> DataFrame:
        status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
        layer = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
        quoted = F.concat(F.lit('"'), prio, F.lit('"'))
        last = F.struct(
            F.when(status == "F", F.array(F.lit("last"))).otherwise(F.array(F.lit("last"), status)).alias("path"),
            F.when((status == "F") & (prio == "5-LOW"), "{}").otherwise(quoted).alias("value_json"),
        )
        seen = F.struct(
            F.array(F.lit("seen"), prio).alias("path"), F.col("o_orderkey").cast("string").alias("value_json")
        )
        return self.t("orders").select(
            F.col("o_custkey").alias("key"), layer.alias("layer"), F.explode(F.array(last, seen)).alias("l")
        ).select("key", "layer", "l.path", "l.value_json")

    def urls(self) -> DataFrame:
        forms = F.array(*[F.concat(F.col("url"), F.lit(end)) for end in ("", "/v1", "/v1/", "//")])
        return self.t("pages").select("page_id", F.explode(forms).alias("url"))

    def strings(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value").cast("string")
        return self.t("events").select(
            "event_id",
            F.when(kind != "view", value).alias("as_float"),
            F.when(kind == "click", kind).otherwise(F.get_json_object("props", "$.k")).alias("as_int"),
            F.when(kind == "view", "TRUE").when(kind == "click", "1").when(kind == "purchase", "Yes")
            .when(kind == "error", "maybe").alias("as_bool"),
            F.when(kind == "error", "   ").otherwise(kind).alias("as_text"),
        )

    def life(self) -> DataFrame:
        kind = F.col("event_type")
        event = F.when(kind == "signup", "start").when(kind == "purchase", "complete").when(kind == "error", "fail")
        return (
            self.t("events")
            .select(
                "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", F.col("event_id").alias("id"),
                event.alias("event"), F.concat(F.lit("failed with "), F.col("props")).alias("message"),
            )
            .filter(F.col("event").isNotNull())
        )
