"""Passes that add nodes and edges to a graph of code: its scaffold, calls, environment, services and handlers.

A pass gives a GraphView of what it adds; add() puts it into a graph, where of nodes of one identity the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexloom.graph import EDGE_COLUMNS, NODE_COLUMNS, GraphView
from plexloom.operators.enrich import canonical_route, next_definition
from plexloom.operators.names import annotated_method, first_literal, graphql_operation, grpc_method, http_method, trpc_procedure

# Words in a call's context that tell its protocol; brokers by word, in order.
HTTP = """requests httpx aiohttp urllib urllib3 httplib2 pycurl treq uplink axios superagent needle node-fetch undici ofetch wretch sindresorhus/ky phin net/http resty sling heimdall
gentleman retryablehttp HttpClient OkHttp okhttp3 RestTemplate WebClient Unirest AsyncHttpClient apache.http Retrofit Feign ktor.client kittinunf.fuel reqwest hyper surf ureq isahc
attohttpc RestSharp Flurl Refit HTTParty Faraday RestClient Typhoeus Excon Net::HTTP Guzzle guzzle curl Symfony\\HttpClient cpr cpp-httplib Poco.Net Beast Alamofire Moya URLSession Dio
dio package:http Chopper HTTPoison Tesla Finch Mint.HTTP sttp akka.http http4s scalaj wreq http-client http-conduit servant-client Network.HTTP socket.http resty.http""".split()
GRPC = "google.golang.org/grpc grpc. grpcio io.grpc ManagedChannel Grpc.Net.Client GrpcChannel Grpc.Core @grpc/grpc-js grpc-web tonic package:grpc ServiceClient BlockingStub Servicer".split()
GRAPHQL = "graphql apollo urql relay gqlgen juniper async-graphql graphene strawberry".split()
TRPC = "@trpc/server @trpc/client @trpc/react-query createTRPCRouter trpc.".split()
BROKERS = {
    "cloudtasks": "cloud_tasks", "cloud_tasks": "cloud_tasks", "cloud.tasks": "cloud_tasks", "CloudTasks": "cloud_tasks", "pubsub": "pubsub", "cloud.pubsub": "pubsub",
    "PubSub": "pubsub", "aws-sdk-go/service/sqs": "sqs", "aws-sdk-go.service.sqs": "sqs", "aws_sdk_sqs": "sqs", "Amazon.SQS": "sqs", "@aws-sdk/client-sqs": "sqs",
    "boto3.client.sqs": "sqs", "aws-sdk-go/service/sns": "sns", "aws_sdk_sns": "sns", "Amazon.SNS": "sns", "@aws-sdk/client-sns": "sns", "eventbridge": "eventbridge",
    "EventBridge": "eventbridge", "aws_sdk_lambda": "lambda", "@aws-sdk/client-lambda": "lambda", "stepfunctions": "stepfunctions", "ServiceBus": "servicebus",
    "Azure.Messaging": "servicebus", "kafka": "kafka", "Kafka": "kafka", "kafkajs": "kafka", "sarama": "kafka", "rdkafka": "kafka", "confluent": "kafka", "amqp": "rabbitmq",
    "AMQP": "rabbitmq", "amqplib": "rabbitmq", "RabbitMQ": "rabbitmq", "lapin": "rabbitmq", "MassTransit": "rabbitmq", "nats": "nats", "NATS": "nats", "ioredis": "redis",
    "celery": "celery", "Celery": "celery", "dramatiq": "dramatiq", "huey": "huey", "python-rq": "rq", "rq.Queue": "rq", "bullmq": "bullmq", "BullMQ": "bullmq",
    "bull.Queue": "bull", "Sidekiq": "sidekiq", "sidekiq": "sidekiq", "Resque": "resque", "GoodJob": "goodjob", "DelayedJob": "delayed_job", "Hangfire": "hangfire",
    "NServiceBus": "nservicebus", "asynq": "asynq", "RichardKnop/machinery": "machinery", "temporalio": "temporal", "@temporalio": "temporal", "temporal.client": "temporal",
    "temporal.worker": "temporal", "inngest": "inngest", "Oban": "oban", "Broadway": "broadway", "GenStage": "genstage", "Phoenix.PubSub": "phoenix_pubsub", "Alpakka": "alpakka",
    "mqtt": "mqtt", "MQTTClient": "mqtt", "mosquitto": "mqtt", "rumqttc": "mqtt", "dapr.clients.grpc": "dapr", "DaprClient": "dapr",
}
LISTENERS = {"kafkalistener": "kafka", "sqslistener": "sqs", "rabbitlistener": "rabbitmq", "eventpattern": "nestjs", "messagepattern": "nestjs", "pubsubsubscription": "pubsub", "celery.task": "celery", "sidekiq": "sidekiq", "queue.process": "bull"}
_WORD = r"^[\p{L}\p{N}_]+$"


def add(view: GraphView, *parts: GraphView) -> GraphView:
    """The graph with what passes have found: of nodes of one qualified name and label those of the graph stay, else the
    first by id; of edges of one identity one."""
    nodes, edges = view.nodes.withColumn("__p", F.lit(0)), view.edges
    for k, part in enumerate(parts):
        nodes, edges = nodes.unionByName(part.nodes.withColumn("__p", F.lit(k + 1)), allowMissingColumns=True), edges.unionByName(part.edges, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("project", "id").orderBy("__p", "properties"))
    return GraphView(nodes.withColumn("__r", first).filter("__r = 1").drop("__r", "__p"), edges.dropDuplicates(["project", "source", "target", "kind", "discriminator"]))


def _nodes(df: DataFrame, project: str, label: str, name: Column, qualified: Column, file=None, **props: Column) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(project).alias("project"), F.concat(F.lit(label.lower() + ":"), qualified).alias("id"), F.lit(label).alias("label"), name.alias("name"), qualified.alias("qualified_name"),
        (none if file is None else file).cast("string").alias("file_path"), none.cast("long").alias("start_line"), none.cast("long").alias("end_line"), (F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")).alias("properties"),
    ).dropDuplicates(["id"])


def _edges(df: DataFrame, project: str, source: Column, target: Column, kind, discriminator=None, **props: Column) -> DataFrame:
    kind, mark = kind if isinstance(kind, Column) else F.lit(kind), F.lit("") if discriminator is None else discriminator
    return df.select(F.lit(project).alias("project"), source.alias("source"), target.alias("target"), kind.alias("kind"), mark.alias("discriminator"), (F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")).alias("properties"))


def scaffold(files: DataFrame, project: str, root: str) -> GraphView:
    """The project, its working-tree branch, and a File node with a CONTAINS_FILE edge for each of files (path)."""
    one = files.sparkSession.range(1)
    branch = f"{project}.__branch__.working-tree"
    nodes = _nodes(one, project, "Project", F.lit(project), F.lit(project), root_path=F.lit(root)).unionByName(_nodes(one, project, "Branch", F.lit("working-tree"), F.lit(branch), branch=F.lit("working-tree")))
    own = files.select("path").distinct()
    nodes = nodes.unionByName(_nodes(own, project, "File", F.substring_index("path", "/", -1), F.col("path"), F.col("path")))
    edges = _edges(one, project, F.lit(f"project:{project}"), F.lit(f"branch:{branch}"), "HAS_BRANCH")
    return GraphView(nodes, edges.unionByName(_edges(own, project, F.lit(f"branch:{branch}"), F.concat(F.lit("file:"), "path"), "CONTAINS_FILE")))


def settle(view: GraphView) -> GraphView:
    """The first of Module nodes of one id and qualified name stays, and edges without both ends go."""
    first = F.row_number().over(Window.partitionBy("id", "qualified_name").orderBy("file_path", "start_line"))
    modules = view.nodes.filter("label = 'Module'").withColumn("__r", first).filter("__r = 1").drop("__r")
    nodes = view.nodes.filter("label <> 'Module'").unionByName(modules)
    ids = nodes.select("id").distinct()
    edges = view.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return GraphView(nodes, edges.select(view.edges.columns))


def call_edges(calls: DataFrame, resolved: DataFrame, project: str) -> DataFrame:
    """CALLS edges of calls (call_id, source, callee, line, start) that resolve_calls() has resolved."""
    both = calls.join(resolved, "call_id")
    return _edges(both, project, F.col("source"), F.col("target"), "CALLS", F.col("start").cast("string"), callee=F.col("callee"), line=F.col("line"), strategy=F.col("strategy"))


def relation_edges(relations: DataFrame, resolved: DataFrame, project: str) -> DataFrame:
    """INHERITS or IMPLEMENTS edges of relations (relation_id, source, kind) that resolve_relations() has resolved."""
    return _edges(relations.join(resolved, "relation_id"), project, F.col("source"), F.col("target"), F.col("kind"), None, strategy=F.col("strategy"))


def environment(calls: DataFrame, project: str) -> GraphView:
    """EnvVar nodes and CONFIGURES edges of calls (source, callee, text) that read a variable of an upper-case name."""
    low = F.lower("callee")
    access = F.contains(low, F.lit("getenv")) | F.contains(low, F.lit("get_environment_variable")) | F.contains(low, F.lit("getenvironmentvariable")) | F.endswith(low, F.lit("env::var")) | F.endswith(low, F.lit("env.var"))
    key = F.col("key")
    found = calls.filter(access).withColumn("key", first_literal(F.col("text"))).filter(key.rlike("^[A-Z0-9_]{2,}$") & key.rlike("[A-Z]"))
    qualified = F.concat(F.lit("__env__"), key)
    edges = _edges(found, project, F.col("source"), F.concat(F.lit("envvar:"), qualified), "CONFIGURES", None, strategy=F.lit("env_access")).dropDuplicates(["source", "target"])
    return GraphView(_nodes(found, project, "EnvVar", key, qualified, None, env_key=key), edges)


def _lines(files: DataFrame) -> DataFrame:
    """(path, n, line, text) of files (path, text); line without \\r at its end."""
    return files.select("path", "text", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def _offset() -> Column:
    """Bytes before line n (from 0)."""
    return F.when(F.col("n") == 0, F.lit(0)).otherwise(F.octet_length(F.expr("substring_index(text, '\\n', n)")) + 1).cast("long")


def _handles(found: DataFrame, project: str) -> DataFrame:
    return _edges(found, project, F.col("handler"), F.concat(F.lit("route:"), "route"), "HANDLES", None, handler=F.col("handler_name"))


def decorator_routes(files: DataFrame, functions: DataFrame, project: str) -> GraphView:
    """Route nodes and HANDLES edges of annotations with a path in files (path, text), each for the next of functions (id,
    qualified_name, file_path, start: byte) in the file."""
    at = _lines(files).withColumn("method", annotated_method(F.col("line"))).withColumn("literal", first_literal(F.col("line"))).filter(F.col("method").isNotNull() & F.startswith("literal", F.lit("/")))
    marks = at.select(F.col("path").alias("file"), _offset().alias("at"), "method", "literal")
    next_ = next_definition(marks, functions.select(F.col("file_path").alias("file"), "start", "id")).filter("id is not null").dropDuplicates(["file", "at"])
    found = marks.join(next_, ["file", "at"]).join(functions.select("id", F.col("qualified_name").alias("handler_name")), "id")
    found = found.select(F.col("id").alias("handler"), "handler_name", "file", "method", "literal", F.concat_ws("__", F.lit("__route"), "method", canonical_route(F.col("literal"))).alias("route"))
    nodes = _nodes(found, project, "Route", F.col("literal"), F.col("route"), F.col("file"), method=F.col("method"), source=F.lit("decorator"))
    return GraphView(nodes, _handles(found, project).dropDuplicates(["source", "target"]))


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _one(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for w, value in reversed(list(table.items())):
        out = F.when(F.contains(c, F.lit(w)), value).otherwise(out)
    return out


def services(calls: DataFrame, imports: DataFrame, project: str, local: DataFrame | None = None) -> GraphView:
    """Route nodes and edges of calls (call_id, source, file, callee, short, text) to services, by what their callee and
    its import (file, alias, module) tell: gRPC, else GraphQL, else tRPC, else HTTP, else a broker.  fetch counts as HTTP
    where it isn't a call of the project's own (local: call_id)."""
    alias = F.coalesce(F.try_element_at(F.filter(F.split("callee", r"[.:/\\]"), lambda x: x != ""), F.lit(1)), F.col("short"))
    one = imports.groupBy(F.col("file").alias("__f"), F.col("alias").alias("__a")).agg(F.min("module").alias("module"))
    c = calls.withColumn("__alias", alias).join(one, (F.col("file") == F.col("__f")) & (F.col("__alias") == F.col("__a")), "left")
    c = c.withColumn("context", F.concat_ws(".", "module", "callee")).withColumn("literal", first_literal(F.col("text")))
    own = local.select("call_id", F.lit(True).alias("__own")).distinct() if local is not None else c.sparkSession.createDataFrame([], f"call_id {calls.schema['call_id'].dataType.simpleString()}, __own boolean")
    c = c.join(own, "call_id", "left")
    context, literal = F.col("context"), F.col("literal")
    grpc = F.when(_any(context, GRPC), F.coalesce(grpc_method(context), grpc_method(F.col("callee"))))
    graphql = F.when(_any(F.lower(context), [w.lower() for w in GRAPHQL]), F.nullif(F.coalesce(graphql_operation(literal), F.col("short")), F.lit("")))
    trpc = F.when(_any(context, TRPC), trpc_procedure(F.col("callee")))
    is_http = ((F.lower("short") == "fetch") & F.col("__own").isNull()) | _any(context, HTTP)
    http = F.when(is_http & (F.startswith(literal, F.lit("/")) | F.contains(literal, F.lit("://"))), F.coalesce(http_method(F.col("callee")), F.lit("ANY")))
    broker = F.when(F.length(literal) > 2, _one(context, BROKERS))
    grpc_name = F.concat_ws("/", grpc["service"], grpc["method"])
    made = lambda kind, name, route, method: F.struct(F.lit(kind).alias("kind"), name.alias("name"), route.alias("route"), method.cast("string").alias("method"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    hit = (
        F.when(grpc.isNotNull(), made("GRPC_CALLS", grpc_name, text("__grpc__", grpc_name), grpc["method"]))
        .when(graphql.isNotNull(), made("GRAPHQL_CALLS", graphql, text("__graphql__", graphql), F.lit(None)))
        .when(trpc.isNotNull(), made("TRPC_CALLS", trpc, text("__trpc__", trpc), F.lit(None)))
        .when(http.isNotNull(), made("HTTP_CALLS", literal, text("__route__", http, "__", canonical_route(literal)), http))
        .when(broker.isNotNull(), made("ASYNC_CALLS", literal, text("__route__", broker, "__", literal), broker))
    )
    found = c.withColumn("hit", hit).filter("hit is not null").select("source", "callee", "hit.*")
    nodes = _nodes(found, project, "Route", F.col("name"), F.col("route"), None, method=F.col("method"))
    edges = _edges(found, project, F.col("source"), F.concat(F.lit("route:"), "route"), F.col("kind"), None, callee=F.col("callee"), route=F.col("name"), method=F.col("method"))
    return GraphView(nodes, edges.dropDuplicates(["source", "target", "kind"]))


def declarations(files: DataFrame) -> DataFrame:
    """(path, at, name, route, source, hint, broker) of handlers declared in files (path, text): gRPC services, GraphQL
    types and annotations, tRPC routers, listeners of brokers.  What a line stands in is carried down its file."""
    lines = _lines(files).withColumn("t", F.btrim("line", F.lit(" \t\r\f"))).withColumn("low", F.lower("t"))
    kind = F.lower(F.substring_index("path", ".", -1))
    t, low = F.col("t"), F.col("low")
    proto, schema = kind == "proto", kind.isin("graphql", "gql")
    word = lambda c, by: F.try_element_at(F.filter(F.split(c, by), lambda x: x.rlike(_WORD)), F.lit(1))
    head = lambda c, by: F.element_at(F.split(c, by), 1)
    service = F.when(proto & F.startswith(t, F.lit("service ")), F.struct(word(F.substr(t, F.lit(9)), r"[\s{]").alias("v")))
    type_ = head(F.regexp_replace(t, r"^(?:extend )?type ", ""), r"[\s{]")
    gql = F.when(schema & t.rlike(r"^(?:extend )?type "), F.struct(F.when(type_.isin("Query", "Mutation", "Subscription"), type_).alias("v")))
    left = F.try_element_at(F.filter(F.split(head(t, "="), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(_WORD)), F.lit(-1))
    base = F.regexp_replace(left, "Router$", "")
    router = F.when(F.contains(low, F.lit("createtrpcrouter")), F.struct(F.concat(F.lower(F.left(base, F.lit(1))), F.substr(base, F.lit(2))).alias("v")))
    closed = F.struct(F.lit(None).cast("string").alias("v"))
    end, end_router = t == "}", F.startswith(t, F.lit("});")) | (t == "}")
    by = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    state = lambda opened, close: F.last(F.when(close, closed).otherwise(opened), True).over(by)["v"]
    s = lines.withColumn("service", state(service, end)).withColumn("gql", state(gql, end)).withColumn("router", state(router, end_router))
    literal = first_literal(t)
    row = lambda name, route, source, hint, broker=None: F.struct(name.alias("name"), route.alias("route"), F.lit(source).alias("source"), hint.cast("string").alias("hint"), (F.lit(None) if broker is None else broker).cast("string").alias("broker"))
    rpc = F.when(proto & F.startswith(t, F.lit("rpc ")) & F.col("service").isNotNull(), word(F.substr(t, F.lit(5)), r"[\s(]"))
    full = F.concat_ws("/", "service", rpc)
    member = F.when(schema & F.col("gql").isNotNull() & ~t.rlike(r"^(?:extend )?type |^[#}@]"), word(t, r"[\s:(]"))
    procedure = F.btrim(F.substring_index(t, ":", 1))
    is_procedure = F.col("router").isNotNull() & ~F.contains(low, F.lit("createtrpcrouter")) & _any(low, [".query(", ".mutation(", ".subscription(", "publicprocedure"]) & F.contains(t, F.lit(":")) & procedure.rlike(_WORD)
    dotted = F.concat_ws(".", "router", procedure)
    marked = ~schema & low.rlike("^@(?:query|mutation|subscription)")
    named = F.when(literal.rlike(_WORD), literal)
    broker = _one(low, LISTENERS)
    found = F.array_compact(
        F.array(
            F.when(rpc.isNotNull(), row(full, F.concat(F.lit("__grpc__"), full), "grpc", rpc)),
            F.when(member.isNotNull(), row(member, F.concat(F.lit("__graphql__"), member), "graphql", member)),
            F.when(is_procedure, row(dotted, F.concat(F.lit("__trpc__"), dotted), "trpc", procedure)),
            F.when(marked, row(F.coalesce(named, F.lit("")), F.concat(F.lit("__graphql__"), F.coalesce(named, F.lit(""))), "graphql", named)),
            F.when(broker.isNotNull() & literal.isNotNull(), row(literal, F.concat(F.lit("__route__"), broker, F.lit("__"), literal), "async_listener", F.lit(None), broker)),
        )
    )
    return s.withColumn("found", found).filter(F.size("found") > 0).select("path", _offset().alias("at"), F.explode("found").alias("f")).select("path", "at", "f.*")


def nearest_handler(marks: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """marks (path, at, hint, ...) with the handler and its names: of functions (id, name, qualified_name, file_path, start)
    in the file the nearest one whose name is the hint or ends in it; else the next one; else the file's node of files
    (id, name, qualified_name, file_path).  Marks without any go."""
    m = marks.withColumn("__m", F.xxhash64(*marks.columns))
    f = functions.select("id", "name", "qualified_name", F.col("file_path").alias("path"), "start")
    near = m.select("__m", "path", "at", "hint").join(f, "path").filter(F.endswith("name", F.col("hint")))
    near = near.groupBy("__m").agg(F.min(F.struct(F.abs(F.col("start") - F.col("at")).alias("far"), "start", "id")).alias("b")).select("__m", F.col("b.id").alias("near"))
    after = next_definition(m.select(F.col("path").alias("file"), "at").distinct(), f.select(F.col("path").alias("file"), "start", "id")).select(F.col("file").alias("path"), "at", F.col("id").alias("after")).dropDuplicates(["path", "at"])
    own = files.groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("own"))
    chosen = m.join(near, "__m", "left").join(after, ["path", "at"], "left").join(own, "path", "left").withColumn("handler", F.coalesce("near", "after", "own")).filter("handler is not null")
    names = functions.select("id", "name", "qualified_name").unionByName(files.select("id", "name", "qualified_name")).select(F.col("id").alias("handler"), F.col("name").alias("handler_short"), F.col("qualified_name").alias("handler_name"))
    return chosen.join(names, "handler").select(*marks.columns, "handler", "handler_short", "handler_name")


def protocol_handlers(files: DataFrame, functions: DataFrame, file_nodes: DataFrame, project: str) -> GraphView:
    """Route nodes and HANDLES edges of declarations(); one of GraphQL without a name has its handler's."""
    found = nearest_handler(declarations(files), functions, file_nodes)
    bare = (F.col("source") == "graphql") & (F.col("name") == "")
    found = found.withColumn("route", F.when(bare, F.concat(F.lit("__graphql__"), "handler_short")).otherwise(F.col("route"))).withColumn("name", F.when(bare, F.col("handler_short")).otherwise(F.col("name")))
    nodes = _nodes(found, project, "Route", F.col("name"), F.col("route"), F.col("path"), source=F.col("source"), broker=F.col("broker"))
    return GraphView(nodes, _handles(found, project).dropDuplicates(["source", "target"]))


__all__ = ["EDGE_COLUMNS", "NODE_COLUMNS", "add", "call_edges", "declarations", "decorator_routes", "environment", "nearest_handler", "protocol_handlers", "relation_edges", "scaffold", "services", "settle"]
