"""The url model on hosts that its table does not hold."""

from lexaudit.llm import url_filter

SUBS = ("", "www.", "blog.", "m.")
PATHS = ("/en/7", "/de/12/", "/fr/345.html", "/es/8", "")


def rate(model, hosts):
    """Share of urls blocked, over subdomains, top levels and plain paths."""
    seen = [model.probability(f"{s}{h}.example.{t}", p) >= 0.5 for h in hosts for s in SUBS for t in ("com", "org", "net") for p in PATHS]
    return sum(seen) / len(seen)


def test_unwanted_hosts_left_out_of_the_table_are_blocked():
    table = url_filter.labelled_urls()
    assert not any(out in host for host, _, label in table if label for out in ("casino-win.", "free-bets.", "cheap-pills.", "ads-track.", "spam-farm.", "adult-x."))
    model = url_filter.fit(table)
    assert rate(model, ["casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x"]) > 0.95
    assert rate(model, ["thering", "library-garden", "weatherscience", "villagemuseum", "north-forum"]) < 0.05


def test_every_fifth_host_left_out():
    table = url_filter.labelled_urls()
    out, rest = table[::5], [r for i, r in enumerate(table) if i % 5]
    model = url_filter.fit(rest)
    for label, low, high in ((0, 0.0, 0.1), (1, 0.7, 1.0)):
        own = [model.probability(h, "/en/7") >= 0.5 for h, _, y in out if y == label]
        assert low <= sum(own) / len(own) <= high


def test_classes_share_subdomains_tops_and_paths():
    table = url_filter.labelled_urls()
    for cut in (lambda h, p: next(s for s in ("www.", "blog.", "m.", "") if h.startswith(s)), lambda h, p: h.rpartition(".")[2], lambda h, p: p[:4] if p[:4] in ("/en/", "/de/", "/fr/", "/es/") else ""):
        shares = [{}, {}]
        for host, path, label in table:
            shares[label][cut(host, path)] = shares[label].get(cut(host, path), 0) + 1
        sizes = [sum(x.values()) for x in shares]
        assert shares[0].keys() == shares[1].keys()
        assert all(abs(shares[0][k] / sizes[0] - shares[1][k] / sizes[1]) < 0.05 for k in shares[0])
