"""A loopback JSON service over a fitted pipeline: status, catalog, layout and traces of single alerts, and pulses over a graph."""

from __future__ import annotations

import json
import re
import socket
import time
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph
from .plans import inspection
from .plans.pipeline import Fitted
from .runtime import cut
from .sources.files import MAX_FIELD_CHARS, MAX_FIELDS, strict

#: Bytes of a request body; hosts that may ask.
MAX_BODY = 64 * 1024
HOSTS = ("127.0.0.1", "localhost")
#: Published paths, and those used here. Fixed values.
PATHS = {"/api/fly/layout": "/api/layout", "/api/fly/trace": "/api/trace", "/api/connectome/scene": "/api/graph/scene", "/api/connectome/pulse": "/api/graph/pulse"}
NODE = re.compile(r"/api/(?:connectome/neuron|graph/node)/(\d{1,18})")
#: Units of the layout, nodes and edges of a scene, and nodes of a pulse's frame that are sent at most; steps of a pulse.
SHOWN, STEPS = 2000, 20


def flat_record(value: object) -> dict[str, str]:
    """A flat alert of bounded size; anything else is an error. Values are text and never evaluated."""
    if not isinstance(value, dict) or not value or len(value) > MAX_FIELDS:
        raise ValueError("an alert is one flat object")
    if any(isinstance(v, (dict, list)) for v in value.values()):
        raise ValueError("an alert has no nested values")
    out = {str(k): "" if v is None else str(v) for k, v in value.items()}
    if any(len(v) > MAX_FIELD_CHARS for v in out.values()):
        raise ValueError("a field is too long")
    return {"alert_id": "MANUAL"} | out


def traced(model: Fitted, record: dict[str, str]) -> dict:
    spark = model.edges.sparkSession
    began = time.perf_counter()
    row = spark.createDataFrame([tuple(record.values())], ", ".join(f"`{k}` string" for k in record)).withColumn("id", F.lit(-1).cast("long"))
    parts = model.trace(row)
    out = {k: [r.asDict() for r in parts[k].collect()] for k in ("inputs", "activations", "winners", "edges", "inspection", "prediction")}
    return strict({"alert_id": record["alert_id"], **out, "seconds": round(time.perf_counter() - began, 6)})


@dataclass
class Graph:
    """Nodes (``node, class``, and more) and transition (``src, dst, p``) that pulses run over."""

    nodes: DataFrame
    transition: DataFrame

    def node(self, name: int) -> dict | None:
        row = self.nodes.where(F.col("node") == name).first()
        return None if row is None else row.asDict()

    def scene(self) -> dict:
        """A uniform sample of nodes and edges to draw."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {"nodes": rows(graph.sample(self.nodes, ["node"], SHOWN)), "edges": rows(graph.sample(self.transition, ["src", "dst"], SHOWN))}

    def pulse(self, request: object) -> dict:
        if not isinstance(request, dict) or not isinstance(request.get("class"), str):
            raise ValueError("a pulse names a class")
        steps, amplitude = request.get("steps", 3), request.get("amplitude", 1.0)
        if not isinstance(steps, int) or isinstance(steps, bool) or not 1 <= steps <= STEPS or isinstance(amplitude, bool) or not isinstance(amplitude, (int, float)):
            raise ValueError(f"steps must lie between 1 and {STEPS}, and the amplitude is a number")
        state, frames = graph.pulse(self.nodes, request["class"], amplitude), []
        for step in range(steps + 1):
            if step:
                state = graph.diffuse(self.transition, state, 1)
            top = [r.asDict() for r in graph.strongest(state, SHOWN).collect()]
            frames.append({"step": step, **graph.frame_summary(state).first().asDict(), "strongest": top})
        return {"class": request["class"], "frames": frames}


def handler(model: Fitted, port: int, net: Graph | None = None):
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, value: object) -> None:
            body = json.dumps(strict(value), allow_nan=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def allowed(self) -> bool:
            host = (self.headers.get("Host") or "").rsplit(":", 1)[0]
            origin = self.headers.get("Origin")
            return host in HOSTS and (origin is None or origin in {f"http://{h}:{port}" for h in HOSTS})

        def do_GET(self) -> None:  # noqa: N802
            path = PATHS.get(self.path, self.path)
            if not self.allowed():
                self.reply(403, {"error": "not allowed"})
            elif path == "/api/status":
                self.reply(200, inspection.status(model.history, model.prints, model.limit))
            elif path == "/api/layout":
                spark = model.edges.sparkSession
                rows = graph.sample(inspection.layout(spark, model.shape[1], model.settings["seed"]), ["kc"], SHOWN)
                self.reply(200, [r.asDict() for r in rows.orderBy("kc").collect()])
            elif net is not None and path == "/api/graph/scene":
                self.reply(200, net.scene())
            elif net is not None and (m := NODE.fullmatch(path)):
                found = net.node(int(m[1]))
                self.reply(*((200, found) if found is not None else (404, {"error": "unknown node"})))
            elif path == "/api/alerts":
                has = [c for c in ("id", "alert_id", "alert_name", "family", "verdict") if c in model.history.columns]
                self.reply(200, [r.asDict() for r in model.history.select(*has).orderBy("id").limit(1000).collect()])
            else:
                self.reply(404, {"error": "unknown path"})

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            path = PATHS.get(self.path, self.path)
            if not self.allowed() or self.headers.get_content_type() != "application/json":
                self.reply(403, {"error": "not allowed"})
            elif not 0 < size <= MAX_BODY:
                self.reply(413, {"error": "body too large or empty"})
            elif path != "/api/trace" and (net is None or path != "/api/graph/pulse"):
                self.reply(404, {"error": "unknown path"})
            else:
                try:
                    body = json.loads(self.rfile.read(size))
                    self.reply(200, traced(model, flat_record(body)) if path == "/api/trace" else net.pulse(body))
                except ValueError as e:
                    self.reply(400, {"error": str(e)})

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def network(nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph of ``node, class`` and ``src, dst, w``, cut in the shared folder; an edge end that is no node is an error."""
    if not graph.missing_endpoints(edges, nodes).isEmpty():
        raise ValueError("an edge ends where there is no node")
    return Graph(cut(nodes), cut(graph.transition(graph.adjacency(edges))))


def serve(model: Fitted, port: int = 8765, net: Graph | None = None) -> None:
    """Serve until stopped; a port out of range or in use is an error before anything else."""
    if not 1024 <= port <= 65535:
        raise ValueError("the port must lie between 1024 and 65535")
    with socket.socket() as probe:
        if probe.connect_ex(("127.0.0.1", port)) == 0:
            raise ValueError(f"port {port} is in use")
    ThreadingHTTPServer(("127.0.0.1", port), handler(model, port, net)).serve_forever()
