import random

import pytest

from tallymark.llm import language_fusion as lf
from tallymark.llm import toxicity_chain as tc
from tallymark.llm import url_templates as ut


def rule(host, path):
    best = None
    for said, h, p in ut.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, said)
    return best or (None, None)


def test_addresses_and_rules(spark):
    urls = ["http://A.Example.NET/en/5?x#y", "https://x.net", "http://net/", "http://example.com/de/1", "x://example.com?/de/", "http://a.org/fr/", "http://a.org/fr", None, "", "no scheme/en/", "a://b://c/d", "http://É.example.net/en/é", "http://notexample.com/de/2"]
    df = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls)] + [(None, urls[0], "t")], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in ut.judged(df.selectExpr("*", "CAST(NULL AS boolean) AS bad")).collect()}
    assert len(got) == len(urls) + 1
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        r = got[k]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule(host, path)[0], rule(host, path)[1] or "allow")


def test_bad_branches_are_blocked_and_others_not(spark):
    rnd = random.Random(1)
    pages, labels = [], []
    for k in range(1200):
        part = rnd.choice(["spam", "news", "blog"])
        pages.append((k, f"http://site.edu/{part}/{rnd.randint(1, 10**6)}/x{k}"))
        if k % 2:
            labels.append((k, part == "spam" or rnd.random() < 0.03))
    pages += [(5000 + k, f"http://site.edu/rare{k}/1") for k in range(50)]
    found = ut.judged(ut.with_labels(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "id bigint, bad boolean"))).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.verdict == "block") == ("/spam/" in r.path), r
    assert {r.template for r in found if "/spam/" in r.path} == {"/spam/*/*"}
    assert {r.template.split("/")[1] for r in found if "rare" in r.path} == {"*"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert ut.judged(ut.page_labels(none)).count() == 0
    assert lf.fused(lf.texts_scored(lf.page_rows(none), lf.Likelihood([]), True), []).count() == 0
    assert lf.fused(lf.texts_scored(lf.page_rows(none), lf.Likelihood([("en", "the of and")]), True), ["en"]).count() == 0


def test_evidence_is_weighed(spark):
    words = {"en": "the and of house water road", "de": "der und das haus wasser strasse", "fr": "le et de maison eau rue"}
    rnd = random.Random(3)
    text = lambda lang, n: " ".join(rnd.choices(words[lang].split(), k=n))
    model = lf.Likelihood([(lang, text(lang, 60)) for lang in words for _ in range(20)])
    rows = []
    for k in range(300):
        lang = "de" if k % 3 else "en"
        rows.append((k, f"http://{lang}.host.org/x", f"<html lang={'en' if k % 10 == 0 else lang}><p>{text(lang, 30)}</p><script>the the the</script></html>"))
    rows += [(900, "http://de.host.org/y", None), (901, None, "<html lang='fr'><b></b>"), (902, "http://de.host.org/z", f"<html lang=de><p>{text('fr', 60)}"), (None, "x", "")]
    got = {r.id: r for r in lf.fused(lf.texts_scored(lf.page_rows(spark.createDataFrame(rows, "page_id bigint, url string, html string")), model, True), model.languages).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang == ("de" if k % 3 else "en") for k in range(300))
    assert got[900].lang == "de" and got[902].lang == "fr" and got[902].text_lang == "fr"
    assert got[900].declared is None and 0 < got[900].posterior <= 1


def test_all_languages_have_tables(spark):
    names = [f"l{k:02d}" for k in range(70)] + ["zh"]
    assert lf.Likelihood([(lang, f"text of {lang}") for lang in names]).languages == names
    df = spark.createDataFrame([(k, "en" if k % 50 else names[k // 50], f"words {k}") for k in range(3550)], "doc_id bigint, lang string, text string")
    assert lf.likelihood_from(df, sample=40).languages == sorted([*names, "en"])


def test_declared_language_behind_a_long_prolog(spark):
    prolog = "<!-- " + "licence text\n" * 500 + "-->\n"
    rows = [(1, "http://a.b/x", prolog + "<HTML class=x\nlang='DE-at'><p>x"), (2, "http://a.b/x", " " * 5000 + "<html lang=fr>"), (3, "http://a.b/x", prolog + "<p lang=en>x")]
    got = {r.id: r.declared for r in lf.page_rows(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "de", 2: "fr", 3: None}


def test_a_bad_section_of_a_host_with_many_is_blocked(spark):
    pages = [(k, f"http://big.edu/s{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}/x") for k in range(10_000)]  # 100 sections of 100 pages
    labels = spark.createDataFrame([(k, "/sbc/" in u) for k, u in pages], "id bigint, bad boolean")
    found = ut.judged(ut.with_labels(spark.createDataFrame(pages, "page_id bigint, url string"), labels)).groupBy("verdict", "path").count().collect()
    assert {r.path for r in found if r.verdict == "block"} == {"/sbc/x"} and sum(r["count"] for r in found) == 10_000


def brute_tree(rows):
    """rows (host, path, bad or None) to templates and blocked paths, over plain dictionaries."""
    import math
    import re as regex
    from collections import defaultdict

    shapes = defaultdict(lambda: [0, 0, 0])
    for host, path, bad in rows:
        c = shapes[host, regex.sub("[0-9]+", "{n}", path)]
        c[0] += 1
        c[1] += bad is not None
        c[2] += bool(bad)
    parts = {key: [p for p in key[1].split("/") if p] for key in shapes}
    out = {key: "" for key in shapes}
    live, k = set(shapes), 0
    while True:
        nodes = defaultdict(list)
        for key in live:
            if len(parts[key]) > k:
                nodes[key[0], out[key]].append(key)
        grow = {node: held for node, held in nodes.items() if len(held) > 1 and sum(shapes[key][0] for key in held) >= ut.LEAST_PAGES}
        following = set()
        for node, held in nodes.items():
            if node not in grow:
                for key in held:
                    out[key] += "/*" * (len(parts[key]) - k)
                continue
            labelled, bad = (sum(shapes[key][j] for key in held) for j in (1, 2))
            rate = (bad + 0.5) / (labelled + 1)
            child = defaultdict(lambda: [0, 0, 0])
            for key in held:
                for j in range(3):
                    child[parts[key][k]][j] += shapes[key][j]
            branch = {}
            for part, (n, l, b) in child.items():
                if n >= ut.LEAST_PAGES and l and abs(b / l - rate) > ut.DIFFERENT * math.sqrt(rate * (1 - rate) / l):
                    branch[part] = f"*{min(math.floor(math.asin(math.sqrt((b + 0.5) / (l + 1))) / (math.pi / 2) * ut.CLASSES) + 1, ut.CLASSES)}"
            for key in held:
                name = branch.get(parts[key][k])
                if name and list(branch.values()).count(name) == 1:
                    name = parts[key][k]
                out[key] += "/" + (name or "*")
                following.add(key)
        if not grow:
            break
        live, k = following, k + 1
    every = (sum(c[2] for c in shapes.values()) + 0.1) / (sum(c[1] for c in shapes.values()) + 1)
    by_host, by_template = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, (_, l, b) in shapes.items():
        for held in (by_host[key[0]], by_template[key[0], out[key]]):
            held[0] += l
            held[1] += b
    share = lambda key: (by_template[key[0], out[key]][1] + ut.WEIGHT * (by_host[key[0]][1] + ut.WEIGHT * every) / (by_host[key[0]][0] + ut.WEIGHT)) / (by_template[key[0], out[key]][0] + ut.WEIGHT)
    return {key: (out[key], round(share(key), 6)) for key in shapes}


def test_tree_equals_brute_force(spark):
    import re as regex

    rnd = random.Random(8)
    rows = []
    for k in range(3000):
        host = rnd.choice(["a.edu", "a.edu", "b.edu", "c.edu"])
        one, two = rnd.choice(["spam", "junk", "ads", "news", "u", "v"]), rnd.choice(["x", "y", "z1"])
        rate = {"spam": 0.8, "junk": 0.83, "ads": 0.4}.get(one, 0.05)
        path = f"/{one}/{two}/{rnd.randint(1, 9)}" + "/deep" * rnd.choice([0, 0, 12])
        rows.append((host, path, None if rnd.random() < 0.2 else rnd.random() < rate))
    rows += [("long.edu", "/s" * 3000, True), ("long.edu", "/s" * 3000, True), ("", "", None), ("a.edu", "", False)]
    df = spark.createDataFrame([(k, f"http://{h}{p}" if h else None, b) for k, (h, p, b) in enumerate(rows)], "page_id bigint, url string, bad boolean")
    want = brute_tree(rows)
    got = {r.page_id: r for r in ut.judged(df.unionByName(df.filter("page_id < 0"))).collect()}
    for k, (h, p, _) in enumerate(rows):
        assert (got[k].template, got[k].bad_share) == want[h, regex.sub("[0-9]+", "{n}", p)], (h, p)
    templates = {r.template for r in got.values()}
    assert any("*" in t and t.split("/")[1] in {f"*{n}" for n in range(5, 10)} for t in templates if t)  # spam and junk are one branch


def test_labels_come_from_the_pages_own_text(spark, tmp_path):
    rnd = random.Random(5)
    prose = lambda: " ".join(f"w{rnd.randint(0, 900)}" for _ in range(120))
    rows = [(k, f"http://site.edu/{'thin' if k % 2 else 'full'}/x{k}", f"<html><script>{prose()}</script><p>{'buy now' if k % 2 else prose()}</p></html>") for k in range(200)]
    rows += [(None, None, None), (7, "http://site.edu/thin/none", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = ut.op1_url_templates(spark, str(tmp_path)).collect()
    assert len(found) == 202 and all((r.verdict == "block") == ("/thin/" in r.path) for r in found)
    labels = ut.page_labels(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("bad", ut.F.lit(5)))
    assert labels.columns == ["page_id", "url", "html", "bad"] and labels.filter("bad is null").count() == 2 and labels.filter("bad").count() == 100


def brute_fusion(rows, model):
    """rows (declared, host, suffix, text) to (language, text language, posterior), by the formulas over plain lists."""
    import math
    from collections import defaultdict

    langs, n = model.languages, len(model.languages)
    ll = [model.score(t or "") for *_, t in rows]
    p = [[math.exp(x) / sum(math.exp(y) for y in v) for x in v] for v in ll]
    add = lambda a, b: [x + y for x, y in zip(a, b)]
    host, suffix, told, every = defaultdict(lambda: [0] * (n + 1)), defaultdict(lambda: [0] * (n + 1)), defaultdict(lambda: [0] * n), [0] * n
    for (d, h, s, _), v in zip(rows, p):
        host[h, s], suffix[s], told[d], every = add(host[h, s], [*v, 1]), add(suffix[s], [*v, 1]), add(told[d], v), add(every, v)
    out = []
    for (d, h, s, _), v, likely in zip(rows, p, ll):
        score = []
        for k in range(n):
            share = (every[k] + 1) / (len(rows) + n)
            of_suffix = (suffix[s][k] + lf.PRIOR_WEIGHT * share) / (suffix[s][n] + lf.PRIOR_WEIGHT)
            prior = (max(host[h, s][k] - v[k], 0) + lf.PRIOR_WEIGHT * of_suffix) / (host[h, s][n] - 1 + lf.PRIOR_WEIGHT)
            score.append(likely[k] + math.log((told[d][k] + 1) / (every[k] + n + 1)) + math.log(prior))
        best = max(score)
        out.append((langs[score.index(best)], langs[list(likely).index(max(likely))], 1 / sum(math.exp(x - best) for x in score)))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_fusion_equals_brute_force(spark, monkeypatch, few):
    from tallymark.llm import common

    monkeypatch.setattr(common, "MAX_BROADCAST_GROUPS", 20_000 if few else 0)
    rnd = random.Random(12)
    langs = [f"l{k:02d}" for k in range(80)] if few else ["de", "en", "fr"]
    text = lambda k, size: " ".join(f"{langs[k]}{rnd.choice('abcdef')}{rnd.choice('xyz')}" for _ in range(size))
    model = lf.Likelihood([(x, text(k, 30)) for k, x in enumerate(langs)])
    rows = []
    for i in range(150):
        k = rnd.randrange(len(langs))
        rows.append((rnd.choice([langs[k], langs[k], "xx", None]), rnd.choice(["h1", "h1", "h1", None, f"h{k}"]), rnd.choice(["org", "net/de", None]), rnd.choice([text(k, rnd.randint(0, 6)), "", None])))
    rows += [rows[0], rows[0], ("en", "h1", "org", text(0, 60_000)), (None, None, None, None)]
    df = spark.createDataFrame([(i, t, d, h, s) for i, (d, h, s, t) in enumerate(rows)], "id bigint, text string, declared string, host string, suffix string")
    got = {r.id: r for r in lf.fused(lf.texts_scored(df, model, False), langs).collect()}
    for i, (lang, text_lang, posterior) in enumerate(brute_fusion(rows, model)):
        assert got[i].declared == rows[i][0] and abs(got[i].posterior - posterior) < 1e-9
        assert got[i].lang == lang or posterior < 0.5000001  # equal scores in another order of sums
        assert got[i].text_lang == text_lang


def test_sample_is_chosen_before_texts_are_read(spark):
    df = spark.createDataFrame([(k, "en", f"words {k}") for k in range(500)] + [(900, "de", "ein text")], "doc_id bigint, lang string, text string")
    assert set(lf.likelihood_from(df, sample=20).languages) == {"de", "en"}
    assert lf.likelihood_from(df.filter("false")).languages == []
    twice = lf.likelihood_from(df.union(df), sample=2000)
    assert (twice.log == lf.likelihood_from(df, sample=2000).log).all()


def test_long_texts_do_not_end_training(spark, monkeypatch):
    monkeypatch.setattr(lf, "SAMPLE_CHARS", 3000)
    monkeypatch.setattr(tc, "SAMPLE_CHARS", 3000)
    seen = []
    monkeypatch.setattr(tc.Chain, "fit", lambda texts, labels: seen.append(len(texts)))
    monkeypatch.setattr(lf, "Likelihood", lambda rows: seen.append(len(rows)))
    df = spark.createDataFrame([(k, "en", "long " * 1000 if k % 2 else "short text") for k in range(40)], "doc_id bigint, lang string, text string")
    labels = df.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    tc.chain_for(df, labels)
    lf.likelihood_from(df)
    assert seen == [20, 20]
    with pytest.raises(ValueError):
        tc.chain_for(df.filter("doc_id % 2 = 1"), labels)
