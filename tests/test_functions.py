"""Scalar functions: tables of value and result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import documents, identifiers, titles, venues


def values(spark, function, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i"] + [f"c{k}" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)])
    cols = [F.col(c) for c in df.columns[1:]]
    return [r["v"] for r in df.select("i", function(*cols).alias("v")).orderBy("i").collect()]


def test_identifiers(spark):
    assert values(spark, identifiers.normal_doi, "https://doi.org/10.1145/3292500.3330701", "see 10.1000/ABC).", "none") == ["10.1145/3292500.3330701", "10.1000/abc", None]
    assert values(spark, identifiers.normal_arxiv, "arXiv:1706.03762v5", "cs.LG/0501001", "x") == ["1706.03762", "cs.LG/0501001", None]
    assert values(spark, identifiers.arxiv_year, "1706.03762", "cs/9901001", "math/0501001") == [2017, 1999, 2005]
    urls = values(spark, identifiers.normal_code_url, "github.com/a/b.", "https://github.com/deepmind", "http://www.gitlab.com/a/b/#x", "https://example.org/a/b", "<https://x.github.com/a/b?y=1>", "see https://github.com/a/b")
    assert urls == ["https://github.com/a/b", None, "https://gitlab.com/a/b", None, "https://x.github.com/a/b?y=1", None]
    assert values(spark, identifiers.slug, "Théorie des Jeux: Ünïon!", "") == ["theoriedesjeuxunion", ""]
    assert values(spark, lambda a, t: identifiers.citation_key(F.array(a), F.lit(2017), t), ("Ashish Vaswani", "The Attention Is"), ("Müller, Jan", "Über x")) == ["vaswani2017attention", "muller2017uber"]
    assert values(spark, lambda c: identifiers.target(c)["kind"], "arXiv:1706.03762", "10.1/x", "10.1000/x", "https://a.org", "Some title") == ["arxiv", "title", "doi", "url", "title"]
    assert values(spark, identifiers.escapes_library, "../x", "a/b", "ok") == [True, True, False]
    assert values(spark, identifiers.library_name, " My Lib! ", "a_b.c") == ["my-lib", "a_b.c"]


def test_titles(spark):
    got = values(spark, titles.title_similarity, ("Few-Shot Learners", "FewShot Learners"), ("deep learning", "deep reinforcement learning"), ("", "x"), ("a b", "c d"))
    assert got == [1.0, pytest.approx(0.8), 0.0, 0.0]


def test_venues(spark):
    assert values(spark, venues.clean_venue, "&lt;i&gt;Nature&lt;/i&gt;.", "N/A", " Proc.  of X, ", "x", "A &amp;amp; B") == ["Nature", None, "Proc. of X", None, "A & B"]
    assert values(spark, venues.is_placeholder, "Elsevier BV", "arXiv", "NeurIPS", "n/a", "Cold Spring Harbor Perspectives") == [True, True, False, True, False]
    assert values(spark, venues.is_workshop, "NeurIPS 2023 Workshops", "NeurIPS") == [True, False]
    assert values(spark, lambda v: venues.venue_level(v)["level"], "Proc. of NeurIPS", "AAAI", "AAAI Workshop", "Nature", "Nature Portfolio", "Journal of X", "PLOS ONE") == ["A*", "A*", None, "A*", None, None, "B"]


def test_documents(spark):
    page = "<html><script>x</script><body><nav>menu</nav><p>One &amp; two</p><!-- c --><div>hy-\nphen</div></body></html>"
    assert values(spark, documents.html_to_text, page) == ["One & two\nhyphen"]
    line = "Preprint. Under review."
    text = "\n".join(x for i in range(6) for x in (line, f"A much longer line of prose number {i} that says something " * 3))
    out = values(spark, documents.without_running_lines, text)[0]
    assert out.count(line) == 1 and values(spark, documents.without_running_lines, "same line here\n" * 50)[0].count("same line") == 50
    got = values(spark, lambda t, b: documents.chosen_pages(t, b), (10, 20), (100, 10), (2, 1), (5, 0))
    assert got[0] == list(range(10)) and len(got[1]) == 10 and got[1][:3] == [0, 1, 2] and got[1][-1] == 99 and got[2] == [0] and got[3] == list(range(5))
    assert values(spark, lambda t: documents.head_and_tail(t, 10), "abcdefghijklmnop") == ["abcdefg" + documents.MIDDLE_CUT + "nop"]
    assert values(spark, lambda t: documents.clip_words(t, 4), "one two. three four five", "one two three. four five") == ["one two three four…".replace("two ", "two. "), "one two three."]


def test_back_matter(spark):
    refs = "\n".join(f"[{i}] A. Author. Title. Journal of X, 20{i:02d}. doi:10.1/{i}" for i in range(10, 60))
    text = "Abstract\n" + "Some body text of the paper.\n" * 200 + "References\n" + refs + "\nAppendix A Proofs\n" + "Proof text goes on.\n" * 100
    row = documents.strip_back_matter(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).orderBy("id").collect()
    assert "[12]" not in row[0]["text"] and "Proof text" not in row[0]["text"] and "Some body" in row[0]["text"] and row[1]["text"] is None
    assert "in\nAppendix A.1, where" in documents.cut_appendix("x " * 200 + "in\nAppendix A.1, where we see")


def test_several_reference_lists_and_back_matter():
    from quire.functions.documents import APPENDIX_CUT, REFERENCES_CUT, cut_appendix, cut_references, reference_lists

    prose = "\n".join(["Plain prose that says what was done and why it was done so."] * 60)
    entries = "\n".join(f"[{i}] Lee et al. 2001. In Proc. of Things, pp. {i}." for i in range(60))
    text = f"{prose}\nReferences\n{entries}\nBibliography\n{entries}\nAppendix A: Proofs\n{prose}\nReferences\n{entries}"
    # The second heading is within the first list, which the appendix ends; the third heads a list of its own.
    assert len(reference_lists(text)) == 2
    assert cut_references(text) == f"{prose}{REFERENCES_CUT}Appendix A: Proofs\n{prose}{REFERENCES_CUT}".rstrip()
    assert cut_references(f"References\n{prose}\nReferences\n{prose}") == f"References\n{prose}\nReferences\n{prose}"
    assert cut_appendix(text) == text[: text.index("Appendix A")].rstrip() + APPENDIX_CUT
    sentence = f"{prose}\nAppendix A.1, where it is shown.\n{prose}"
    assert cut_appendix(sentence) == sentence and cut_appendix(f"Appendix\n{prose}") == f"Appendix\n{prose}" and cut_references("") == ""
    # A list that thins out ends without back matter.
    assert cut_references(f"{prose}\nReferences\n{entries}\n{prose}\n{prose}").endswith(prose[-500:])
