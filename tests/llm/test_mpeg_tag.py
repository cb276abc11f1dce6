"""TAG inside a frame is data; after the frames it is a tag."""

import pytest

from lawloom.llm import mpeg


def carried(media):
    s = mpeg.parse(media)
    return s, b"".join(media[a : a + mpeg.UNIT] for a, _ in s.data)


@pytest.mark.parametrize("units", [1, 3])
def test_text_with_tag_at_its_place_comes_back(units):
    payload = bytearray(b"x" * mpeg.UNIT * units)
    at = mpeg.UNIT * (units - 1) + 521
    payload[at : at + 3] = b"TAG"
    media = mpeg.store(bytes(payload))
    assert media[-128:-125] == b"TAG"
    s, data = carried(media)
    assert data == payload and s.tags == ["ID3v2.3"] and s.skipped == s.wrong == 0
    assert s.table_frames == len(s.offsets) == units and s.table_bytes == s.frame_bytes
    # The same with a real tag behind it, with and without junk between.
    for junk in (b"", b"\xffjunk\xff"):
        s, data = carried(media + junk + b"TAG" + bytes(125))
        assert data == payload and s.tags == ["ID3v2.3", "ID3v1"] and s.skipped == len(junk)


def test_frame_cut_off_by_a_tag():
    media = mpeg.store(b"x" * mpeg.UNIT * 2)
    s, data = carried(media[:-50] + b"TAG" + bytes(125))
    assert data == b"x" * mpeg.UNIT and s.tags[-1] == "ID3v1" and s.skipped == mpeg.FRAMES[0] - 50
