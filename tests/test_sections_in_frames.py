"""Sections of a batch of pages come out in frames of bounded size."""

import pandas as pd

from millrace.operators import web


def test_a_batch_of_pages_is_not_held_whole():
    html = "".join(f"<p>paragraph {i}</p>" for i in range(30))
    part = pd.DataFrame({"page_id": range(50), "html": [html] * 49 + [None]})
    frames = list(web._frames([part], False, 100))
    assert max(map(len, frames)) < 130 and len(frames) > 10
    whole = pd.concat(frames, ignore_index=True)
    assert whole[["page_id", "pos"]].values.tolist() == [[p, i] for p in range(49) for i in range(30)]
