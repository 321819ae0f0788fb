"""Files that other programs open, tables in CSV, texts within a budget, and both clients against a stub server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from citeflow.operators import network, text
from citeflow.sources import pajek


def test_one_file_with_a_colour_for_each(spark, tmp_path):
    nodes = spark.createDataFrame([(2, "b", "Red"), (1, "a", None), (10, "c", "Blue")], "id int, label string, paint string")
    ties = spark.createDataFrame([(10, 1, 0.5, "Gray"), (2, 10, 3.0, None), (2, 1, None, "Gray")], "src int, dst int, weight double, paint string")
    pajek.write_network(nodes, ties, str(tmp_path / "folder"), node_colour=F.col("paint"), border_colour="White", tie_colour=F.col("paint"))
    (tmp_path / "a.net").write_text("old")
    pajek.as_file(spark, str(tmp_path / "folder"), str(tmp_path / "a.net"))
    assert not (tmp_path / "folder").exists()
    assert (tmp_path / "a.net").read_text().splitlines() == ["*Vertices 3", '1 "a" bc White', '2 "b" ic Red bc White', '10 "c" ic Blue bc White', "*Arcs", "2 1 1 c Gray", "2 10 3", "10 1 0.5 c Gray"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, None)]
    frame = spark.createDataFrame(rows, "id int, theme string")
    pajek.write_table(frame, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in pajek.read_table(spark, str(tmp_path / "t"), "id int, theme string").collect()) == rows


@pytest.mark.parametrize("length", [0, 1, 3, 4, 5, 50])
def test_budget_reads_no_more_than_it_needs(spark, length):
    rows = [("long", k, "x" * 9 + ".") for k in range(5)] + [("short", k, None if k == 6 else "ab." + "y" * (k * length % 7)) for k in range(5 + length)] + [("one", 0, "z")]
    frame = spark.createDataFrame(rows, "community string, place int, text string")
    get = lambda f: {tuple(r) for r in text.within_budget(f(frame)).collect()}
    assert get(text.core_and_start) == get(text.core_and_rest)


def test_matrix_and_back(spark):
    edges = [(3, 1, 2.0), (1, 7, 0.5), (7, 7, 1.0)]
    nodes = spark.createDataFrame([(k,) for k in (7, 3, 1)], "id long")
    matrix = network.adjacency(spark.createDataFrame(edges, "src long, dst long, w double"), nodes)
    assert sorted(tuple(r) for r in network.from_adjacency(matrix, nodes).collect()) == sorted(edges)


@pytest.fixture
def server():
    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "messages" in body:
                reply = {"choices": [{"message": {"content": f"{self.headers['Authorization']}|{body['messages'][-1]['content']}"}}]}
            else:
                reply = {"response": f"{body['model']}|{body['options']['num_predict']}|{body['prompt']}"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    one = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}"
    one.shutdown()


def test_clients(spark, server):
    assert text.GenerateClient(server, "m")("hello", 5.0) == "m|40|hello"
    assert text.ChatClient(server, "m", "key")("hello", 5.0) == "Bearer key|hello"
    rows = spark.createDataFrame([(1, "hello")], "community int, prompt string")
    found = text.label(rows, text.GenerateClient(server, "m"))
    assert [(r.community_id, r.theme, r.status) for r in found.collect()] == [(1, "m|40|hello", "success")]
    assert text.summary(found).first().n_success == 1
