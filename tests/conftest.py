import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftrank.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.createDataFrame(
        [(1, "red fox red hill"), (2, "blue fox"), (3, "red red red"), (4, "green hill hill fox den")],
        "doc_id long, text string",
    )


@pytest.fixture(scope="session")
def index(corpus):
    from siftrank.operators.analyze import Analyzer
    from siftrank.operators.index import build_index

    return build_index(corpus, analyzer=Analyzer(tokenizer="whitespace"))


@pytest.fixture(scope="session")
def query(spark):
    from siftrank.operators.search import parse_topics

    topics = spark.createDataFrame([(1, "red fox")], "topic_id long, title string")
    return parse_topics(topics)


@pytest.fixture(scope="session")
def ratings(spark):
    table = {
        1: {1: 5, 2: 3, 3: 4},
        2: {1: 3, 2: 1, 3: 2, 4: 3},
        3: {1: 4, 2: 3, 3: 4, 4: 3},
        4: {1: 3, 2: 3, 3: 1, 4: 5},
        5: {1: 1, 2: 5, 3: 5, 4: 2},
    }
    rows = [(u, i, float(r)) for u, items in table.items() for i, r in items.items()]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double")
