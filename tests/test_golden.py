"""Worked examples on tiny rasters."""

import pytest

from pixelframe.functions import color, ordered, tone
from pixelframe.functions.kernels import Kernel, collect_kernels, load_kernels, preset
from pixelframe.layout import RasterArgumentError
from pixelframe.operators import geometry, stencil


def test_convolve_centre(raster, cells):
    kernel = Kernel.of("cross", 0, 1, "0 1 0 / 1 2 1 / 0 1 0")
    out = cells(stencil.convolve(raster([[5, 5, 9], [4, 8, 3], [0, 3, 0]]), kernel))
    assert out[0, 1, 1] == (None, 31, 31, 31)
    assert out[0, 0, 0][1] == 5 * 2 + 5 + 4


def test_convolve_keeps_alpha_and_clamps(raster, cells):
    df = raster([[(7, 200, 0, 10), (8, 250, 1, 20)]])
    out = cells(stencil.convolve(df, Kernel.of("k", -5, 1, "0 0 0 / 1 1 0 / 0 0 0")))
    assert out == {(0, 0, 0): (7, 195, 0, 5), (0, 0, 1): (8, 255, 0, 25)}


def test_convolve_negative_sum_truncates_toward_zero(raster, cells):
    df = raster([[7, 0]])
    out = cells(stencil.convolve(df, Kernel.of("k", 10, 2, "0 0 0 / 0 -1 0 / 0 0 0")))
    assert out[0, 0, 0][1] == 10 - 3


def test_kernel_weight_limit(raster):
    with pytest.raises(RasterArgumentError):
        stencil.convolve(raster([[1]]), Kernel.of("big", 0, 1, "5000"))


def test_median_centre(raster, cells):
    out = cells(stencil.median(raster([[3, 5, 78], [7, 8, 9], [0, 2, 1]]), 1))
    assert out[0, 1, 1] == (None, 5, 5, 5)


def test_color_mix_cycle(raster, cells):
    df = raster([[(1, 2, 3), (200, 100, 50)]])
    out = cells(color.color_mix(df, red="0,1,0", green="0,0,1", blue="1,0,0"))
    assert out == {(0, 0, 0): (None, 2, 3, 1), (0, 0, 1): (None, 100, 50, 200)}


@pytest.mark.parametrize("bit", [0, 7])
def test_bitfield_one_bit(raster, cells, bit):
    out = cells(tone.bitfield(raster([[0, 1, 127, 128, 255]]), bit, bit))
    assert [out[0, 0, x][1] for x in range(5)] == [
        128 * (v >> bit & 1) for v in (0, 1, 127, 128, 255)
    ]


def test_threshold_limit(raster, cells):
    out = cells(tone.threshold_channel(raster([[127, 128, 129]]), 128))
    assert [out[0, 0, x][1] for x in range(3)] == [0, 255, 255]


def test_isolated_pixel_is_removed(raster, cells):
    df = raster([[10, 10, 10], [10, 99, 10], [10, 10, 10]])
    assert cells(stencil.remove_isolated(df))[0, 1, 1][1] == 10


def test_isolated_pixel_on_the_border_stays(raster, cells):
    df = raster([[99, 10, 10], [10, 10, 10], [10, 10, 10]])
    assert cells(stencil.remove_isolated(df))[0, 0, 0][1] == 99


def test_autocrop_flat_image_unchanged(raster, cells):
    df = raster([[4, 4], [4, 4]])
    assert cells(geometry.autocrop(df, 1, 1)) == cells(df)


def test_bayer_orders():
    assert ordered.bayer(1) == [0, 2, 3, 1]
    assert sorted(ordered.bayer(3)) == list(range(64))


def test_argument_checks(raster):
    df = raster([[1]])
    for call in (
        lambda: tone.brightness(df, 1.5),
        lambda: tone.gamma(df, 0),
        lambda: tone.bitfield(df, 5, 2),
        lambda: geometry.rotate_nn(df, 200),
        lambda: stencil.median(df, 6),
        lambda: stencil.hist_eq_local(df, 65),
        lambda: color.transparency(df, 10),
    ):
        with pytest.raises(RasterArgumentError):
            call()


def test_kernel_files(spark, tmp_path, raster, cells):
    weights = "\n".join(["0 0 0 0 0 0 0 "] * 2 + ["0 0 1 2 1 0 0", "0 0 2 4 2 0 0", "0 0 1 2 1 0 0"] + ["0 0 0 0 0 0 0"] * 2)
    (tmp_path / "soft.conv").write_text(f"; a comment\n;another\n3\n0\n16\n{weights}\n")
    table = load_kernels(spark, str(tmp_path))
    assert table.count() == 9
    (kernel,) = collect_kernels(table)
    assert (kernel.name, kernel.bias, kernel.divisor) == ("soft", 0, 16)
    df = raster([[10, 20, 30], [40, 50, 60]])
    assert cells(stencil.convolve(df, kernel)) == cells(stencil.convolve(df, preset("gauss8")))
