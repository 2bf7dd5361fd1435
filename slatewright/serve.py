"""A small loopback scorer over a collected snapshot: GET /health, GET /metadata and
POST /v1/rank.  It serves what a Spark plan made before; it is no Spark connector."""

from __future__ import annotations

import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .sources.strict_json import load

MAX_BODY = 1 << 16


class Snapshot:
    """Ranked articles of each user, best first; bounded when it is collected."""

    def __init__(self, ranked: dict[str, list[tuple[str, float]]], meta: dict[str, object]):
        self.ranked, self.meta = ranked, meta

    @classmethod
    def collect(cls, scored, k: int, users: int = 100_000, by: str = "total") -> Snapshot:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        w = Window.partitionBy("user_id").orderBy(F.desc(by), "id")
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "rank", "id", by)
        if top.select("user_id").distinct().limit(users + 1).count() > users:
            raise ValueError(f"more than {users} users")
        out: dict[str, list[tuple[str, float]]] = {}
        for r in top.orderBy("user_id", "rank").collect():
            out.setdefault(r["user_id"], []).append((r["id"], r[by]))
        return cls(out, {"users": len(out), "k": k})

    def rank(self, request: dict) -> dict:
        if not isinstance(request, dict) or not {"user_id"} <= set(request) <= {"user_id", "k", "candidate_ids"}:
            raise ValueError("a request has user_id and may have k and candidate_ids")
        k = request.get("k", self.meta["k"])
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError("k must be a positive integer")
        rows = self.ranked.get(request["user_id"], [])
        wanted = request.get("candidate_ids")
        if wanted is not None:
            if not isinstance(wanted, list) or len(set(wanted)) < len(wanted):
                raise ValueError("candidate_ids is a list without repeats")
            rows = [r for r in rows if r[0] in set(wanted)]
        return {"user_id": request["user_id"], "ranking": [{"rank": i, "article_id": a, "score": s} for i, (a, s) in enumerate(rows[:k], 1)]}


def server(snapshot: Snapshot, *, port: int = 0, token: str | None = None, workers: int = 16, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Bound to the loopback unless a token is set; over ``workers`` requests get 503."""
    if host not in ("127.0.0.1", "::1", "localhost") and not token:
        raise ValueError("another host needs a token")
    slots = threading.BoundedSemaphore(workers)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            return

        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body, sort_keys=True).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def allowed(self) -> bool:
            return token is None or hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}")

        def do_GET(self) -> None:
            if self.path == "/health":
                self.reply(200, {"status": "ok"})
            elif not self.allowed():
                self.reply(401, {"error": "unauthorized"})
            elif self.path == "/metadata":
                self.reply(200, snapshot.meta)
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if not slots.acquire(blocking=False):
                return self.reply(503, {"error": "busy"})
            try:
                if self.path != "/v1/rank":
                    return self.reply(404, {"error": "not found"})
                if not self.allowed():
                    return self.reply(401, {"error": "unauthorized"})
                length = self.headers.get("Content-Length", "")
                if not length.isdigit() or "Transfer-Encoding" in self.headers:
                    return self.reply(411, {"error": "Content-Length needed"})
                if int(length) > MAX_BODY:
                    return self.reply(413, {"error": "too large"})
                try:
                    self.reply(200, snapshot.rank(load(self.rfile.read(int(length)).decode())))
                except (ValueError, UnicodeDecodeError) as error:
                    self.reply(400, {"error": str(error)})
            finally:
                slots.release()

    return ThreadingHTTPServer((host, port), Handler)
