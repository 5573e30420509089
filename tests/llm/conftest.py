"""Small tables with edge cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))
NEAR = [f"token{i}" for i in range(200)]
EDGE = [
    (90001, None, None), (90002, "", "en"), (90003, "   \n\t ", None), (90004, "one two", "en"), (90005, "One TWO", "en"), (90006, LONG, "en"), (90007, LONG + " end", "en"),
    (90008, "12345 !!! 678", None), (90009, "日本語 <|endoftext|> İΣΑΣ é é \x1c \x00", None), (90010, "mail a@b.co +1 (202) 555-0101 4539 1488 0343 6467 1.2.3.4 999.1.1.1 password=c0ffee00c0ffee1234", "en"),
    *((90100 + i, " ".join(NEAR[:i] + [f"edit{i}"] + NEAR[i + 1 :]), "en") for i in range(40)), *((90200 + i, "the very same text in many rows of this table", "en") for i in range(60)),
    (90300, "repeated row", "en"), (90300, "repeated row", "en"), (None, "a row without an id", None),
]


def documents() -> pd.DataFrame:
    base = pd.read_parquet(f"{DATA}/documents.parquet")
    edge = pd.DataFrame([(i, t, lang, "edge", None if t is None else len(t)) for i, t, lang in EDGE], columns=["doc_id", "text", "lang", "source", "n_chars"])
    out = pd.concat([base, edge], ignore_index=True).astype({"doc_id": "Int64", "n_chars": "Int64"})
    for clash in ("key", "row", "block", "bucket", "node", "score", "lang_pred", "z", "shard"):
        out[clash] = "clash"
    return out


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    if not Path(DATA).exists():
        pytest.skip("no input tables")
    folder = tmp_path_factory.mktemp("tables")
    documents().to_parquet(folder / "documents.parquet")
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    more = pd.DataFrame([(900, "very same text"), (901, None), (902, "..."), (903, " ".join(NEAR[50:63])), (904, " ".join(NEAR[50:63]))], columns=["item_id", "text"])
    pd.concat([items, more], ignore_index=True).to_parquet(folder / "benchmark.parquet")
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    urls = [None, "", "no scheme", "http://", "HTTP://A.Com", "http://A.COM/x", "http://example.com/en/1", "http://www.example.com/en/2?q#f", "https://b.net/es/", "https://net/fr/x", "http://x.net#/es/", "ftp://c.org/a//b/../c", "http://d.org?x=/en/"]
    urls += [f"http://hot.org/user{i}/item/{i}" for i in range(200)] + [f"http://deep.org/{'a/' * 40}{i}" for i in range(5)]
    extra = pd.DataFrame([(90000 + i, u, None) for i, u in enumerate(urls)], columns=["page_id", "url", "html"])
    pd.concat([pages, extra], ignore_index=True).assign(host="clash", path="clash").to_parquet(folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def nothing(tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    for name in ("documents", "benchmark", "pages"):
        pq.write_table(pq.read_table(f"{tables}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs():
    return documents()
