import re

import pytest
import sqlcheck
from test_text_and_filters import pack

from corpusmill.plans import surfaces as plans

needs_tables = pytest.mark.skipif(not sqlcheck.TABLES.exists(), reason="no test tables")


def by_hand(rows):
    """All surfaces of the packages, one readme at a time."""
    out, seen = [], set()
    for _, kind, project, text in sorted(rows):
        if kind != "readme" or text is None or not text.startswith("# "):
            continue
        name = re.match(r"# ([^\r\n]*)", text)[1]
        if name.startswith("x"):
            continue
        aid, _ = (f"{name}@{project or 'none'}" if name in seen else name), seen.add(name)
        first = re.match(r"# [^\r\n]*\n\n([^\r\n]+)", text)
        description = first[1].strip(" ") if first else ""
        deps = ", ".join(dict.fromkeys(re.findall(r"`([a-z]+)\.", text)))
        parts = [("description", f"{name}: {description}" if description else "")] + [("readme_chunk", c) for c in pack(text[:20_000], 1500, 200)] + [("deps", f"Depends on: {deps}" if deps else "")]
        out += [(aid, True, i, *p) for i, p in enumerate(p for p in parts if p[1].strip())]
    return sorted(out)


def test_package_surfaces_against_python(spark, rows, tmp_path):
    """Readmes of one chunk, of several, with a paragraph over the chunk size, without a paragraph, of one name twice and over the readme limit."""
    many = "\n\n".join(f"Paragraph {i} calls `dep.run` and `other.do`. " + "word " * 60 for i in range(12))
    texts = ["# one\n\nA line.", f"# many\n\n{many}", "# long\n\nIntro.\n\n" + "y" * 4000 + "\n\nThe end.", "# bare", f"# many\n\nAgain.\n\n{many}", "# over\n\n" + "\n\n".join(f"p{i} " + "z" * 900 for i in range(40)), "# xout\n\nno", "no title", None]
    docs = [(i, "readme", "proj" if i % 2 else None, t) for i, t in enumerate(texts)] + [(99, "report", None, "# report\n\nno")]
    spark.createDataFrame(docs, "doc_id long, kind string, project string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(plans.surfaces_package(spark, str(tmp_path)), "artifact_id", "has_readme", "surface_index", "surface_kind", "text")
    assert sorted(got) == by_hand(docs) and sum(r[3] == "readme_chunk" for r in got) > 25


@needs_tables
def test_package_surfaces_against_sql(spark):
    """All surfaces, the chunks too: the SQL says the whole query."""
    sqlcheck.compare(spark, sqlcheck.connect(), plans.surfaces_package, plans.ORACLE_SQL["surfaces_package"])
