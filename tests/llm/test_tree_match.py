import random
import time

from millrace.llm import pages


def bones(body):
    return pages.rebuilt(pages.skeleton(pages.parse(f"<html><body>{body}</body></html>")))


def best(a, b, known):
    """The plain recursion with the bonus of equal texts."""
    if (id(a), id(b)) not in known:
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + (best(x, y, known) if x.tag == y.tag else 0))
        known[id(a), id(b)] = m[-1][-1] + (1.5 if a.text and a.text == b.text else 1)
    return known[id(a), id(b)]


def weight(found):
    return sum(1.5 if x.text and x.text == y.text else 1 for x, y in found)


def test_a_partner_far_along_a_long_row_is_found():
    shown = "".join(f"<p>{k}</p>" for k in range(300))
    one, two = bones(shown), bones("".join(f"<p>new {k}</p>" for k in range(200)) + shown)
    found = []
    assert pages.tree_match(one[0], two[0], found) == 3 + 300 * 1.5 == weight(found)
    assert all(x.text == y.text for x, y in found if x.text)


def test_long_rows_equal_the_plain_recursion():
    random.seed(7)

    def row(n, words):
        kinds = random.choices(["<p>{}</p>", "<p><b>{}</b><i>{}</i></p>", "<div><p>{}</p>{}</div>", "<div>{}</div>"], k=n)
        return "".join(k.format(*(f"w{int(random.random() ** 2 * words)}" for _ in range(2))) for k in kinds)

    for n, words in ((70, 3), (90, 12), (110, 60), (130, 1000), (66, 40)):
        one, two = (bones(f"<div>{row(n + random.randint(0, 9), words)}</div><p>end</p>") for _ in range(2))
        found = []
        assert pages.tree_match(one[0], two[0], found) == best(one[0], two[0], {}) == weight(found)
        places = {id(x): k for side in (one, two) for k, x in enumerate(side)}
        kept = {(id(x), id(y)) for x, y in found}
        assert all(x.tag == y.tag and (x.above is None or (id(x.above), id(y.above)) in kept) for x, y in found)
        order = sorted((places[id(x)], places[id(y)]) for x, y in found)
        assert [y for _, y in order] == sorted(y for _, y in order) and len(set(order)) == len(found)


def test_a_long_table_with_its_own_texts_on_both_pages():
    rows = [f"<tr><td>name {k}</td><td>kind {k % 7}</td><td>c</td></tr>" for k in range(3000)]
    one, two = bones("<table>" + "".join(rows) + "</table>"), bones("<table>" + "".join(rows[1000:] + rows[:1000]) + "</table>")
    began, found = time.process_time(), []
    got = pages.tree_match(one[0], two[0], found)
    assert got == weight(found) >= 3 + 2000 * 5.5  # 2000 rows of three texts
    assert sum(x.text == y.text for x, y in found if x.chars) >= 2000 * 3 - 20 and time.process_time() - began < 30
