"""python -m siltstone.service --data-dir DIR [options]: runs the service."""

from __future__ import annotations

import argparse
import logging
import os
import ssl
import subprocess
import tempfile
import threading

from pyspark.sql import SparkSession

from siltstone.limits import PROFILE_ROWS, QUERY_TIMEOUT_S, ROLLUP_CARDINALITY
from siltstone.service.engine import Engine
from siltstone.service.http import serve
from siltstone.sources.catalog import Accelerator


def options(given: list[str] | None = None) -> argparse.Namespace:
    """The command line's options."""
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("-d", "--data-dir", required=True, help="folder of the collections, on any file system Spark can use")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("-p", "--port", type=int, default=8080)
    p.add_argument("--api-key", action="append", default=[], help="may be given several times")
    p.add_argument("--api-key-file", help="a key on each line; empty lines and those that begin with # are left out")
    p.add_argument("--metrics-public", action="store_true")
    p.add_argument("--query-timeout", type=float, default=QUERY_TIMEOUT_S, help="seconds; 0 for none")
    p.add_argument("--ttl-interval", type=float, default=60, help="seconds between runs of retention; 0 for none")
    p.add_argument("--tls", action="store_true", help="HTTPS; with a certificate made now if none is given")
    p.add_argument("--tls-cert")
    p.add_argument("--tls-key")
    p.add_argument("-l", "--log-level", default="info", choices=["trace", "debug", "info", "warn", "error"])
    p.add_argument("--log-file", help="where every request is logged; none: nowhere")
    p.add_argument("-v", "--verbose", action="store_true", help="requests are logged to the terminal too")
    p.add_argument("--bitmap-fields", default="", help="paths to keep joint counts of, with commas between; found if there are none")
    p.add_argument("--bitmap-max-cardinality", type=int, default=ROLLUP_CARDINALITY, help="values that a path found may have")
    p.add_argument("--bitmap-sample-size", type=int, default=PROFILE_ROWS, help="rows from which on paths are looked for, and in how many")
    p.add_argument("--no-bitmap", action="store_true", help="no joint counts are kept or used")
    return p.parse_args(given)


def api_keys(o: argparse.Namespace) -> list[str]:
    """The keys given directly and those of the file."""
    if not o.api_key_file:
        return o.api_key
    with open(o.api_key_file, encoding="utf-8") as f:
        lines = [line.strip() for line in f]
    return [*o.api_key, *(k for k in lines if k and not k.startswith("#"))]


def tls_context(o: argparse.Namespace) -> ssl.SSLContext | None:
    """The certificate to serve with; ``--tls`` alone has one made and signed by itself, for this run."""
    if not (o.tls or o.tls_cert):
        return None
    context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
    if o.tls_cert:
        context.load_cert_chain(o.tls_cert, o.tls_key)
        return context
    with tempfile.TemporaryDirectory() as folder:
        key, cert = os.path.join(folder, "key.pem"), os.path.join(folder, "cert.pem")
        made = ["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-days", "365", "-subj", "/CN=localhost", "-addext", "subjectAltName=DNS:localhost,IP:127.0.0.1", "-keyout", key, "-out", cert]
        subprocess.run(made, check=True, capture_output=True)
        context.load_cert_chain(cert, key)
    return context


def logging_to(o: argparse.Namespace) -> None:
    """Sends the log of requests where the options say."""
    log = logging.getLogger("siltstone")
    log.setLevel({"trace": "DEBUG", "warn": "WARNING"}.get(o.log_level, o.log_level.upper()))
    for handler in [logging.FileHandler(o.log_file)] if o.log_file else []:
        log.addHandler(handler)
    if o.verbose:
        log.addHandler(logging.StreamHandler())
    for handler in log.handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))


def main() -> None:
    """Reads the options, starts retention and serves until interrupted."""
    o = options()
    logging_to(o)
    fields = [f.strip() for f in o.bitmap_fields.split(",") if f.strip()]
    accelerator = Accelerator(not o.no_bitmap, fields, o.bitmap_max_cardinality, o.bitmap_sample_size)
    engine = Engine(SparkSession.builder.appName("siltstone").getOrCreate(), o.data_dir, o.query_timeout, accelerator)
    ended = threading.Event()

    def retention() -> None:
        while not ended.wait(o.ttl_interval):
            try:
                engine.cleanup()
            except Exception:
                logging.getLogger("siltstone.retention").exception("retention failed; it is tried again")

    if o.ttl_interval:
        threading.Thread(target=retention, daemon=True).start()
    server = serve(engine, o.host, o.port, api_keys(o), o.metrics_public, tls_context(o))
    try:
        server.serve_forever()
    finally:
        ended.set()


if __name__ == "__main__":
    main()
