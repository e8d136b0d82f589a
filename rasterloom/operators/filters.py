"""Convolution, correlation and the named filters."""

from __future__ import annotations

from rasterloom.frame import ImageFrame
from rasterloom.operators import neighborhood as n
from rasterloom.operators.engine import WeightedSum, folded
from rasterloom.operators.neighborhood import Border, Kernel, SeparableKernel, fold_neighborhood, in_rows, output_size, weighted_sum, window
from rasterloom.pixel import PixelType, pixel_type


def correlate(frame: ImageFrame, kernel: Kernel, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    """Weighted sums with the kernel as it lies. The result is the accumulator, or rounded and clamped to `pixel`.

    A kernel of rank one runs as two passes only through convolve_separable: a single pass rounds differently.
    """
    p = frame.pixel
    p.require_linear("a weighted sum")
    out, kind, finite = pixel_type(pixel) if pixel is not None else p.accumulator(), p.channel.accumulator, p.max is not None
    if border.in_engine:
        return fold_neighborhood(frame, kernel, border, WeightedSum(kind, finite, out), out)
    fold = weighted_sum(kind, finite)
    columns = {o: window(frame, kernel, border, c, lambda taps, _: out.from_linear(fold(taps))) for c, o in zip(p.channels, out.channels, strict=True)}
    return frame.with_channels(columns, out, *output_size(border, kernel))


def convolve(frame: ImageFrame, kernel: Kernel, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    """True convolution: the kernel is turned by 180 degrees first."""
    return correlate(frame, kernel.flipped(), border, pixel)


def convolve_separable(frame: ImageFrame, kernel: SeparableKernel, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    """A row pass, then a column pass on its float result; the border applies to each."""
    p = frame.pixel
    p.require_linear("a weighted sum")
    between = p.accumulator()
    out = pixel_type(pixel) if pixel is not None else between
    if not border.in_engine:
        return convolve(convolve(frame, kernel.horizontal, border), kernel.vertical, border, out)
    turned, kind = kernel.flipped(), p.channel.accumulator
    first, second = WeightedSum(kind, p.max is not None, between), WeightedSum(kind, False, out)
    # the second pass pads the float result with the same value
    return in_rows(frame, border, out, lambda own, fill: folded(folded(own, turned.horizontal, border, fill, first), turned.vertical, border, fill, second))


def box_blur_3x3(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve_separable(frame, n.BOX_3, border, frame.pixel)


def box_blur_5x5(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve_separable(frame, n.BOX_5, border, frame.pixel)


def gaussian_blur_3x3(frame: ImageFrame, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    """Weights 1 2 1, not divided by their sum: the result is 16 times as bright, and integers saturate."""
    return convolve_separable(frame, n.GAUSSIAN_3, border, pixel or frame.pixel)


def gaussian_blur_5x5(frame: ImageFrame, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    """Weights 1 4 6 4 1, not divided by their sum (256)."""
    return convolve_separable(frame, n.GAUSSIAN_5, border, pixel or frame.pixel)


def sobel_x(frame: ImageFrame, border: Border) -> ImageFrame:
    """Negative where values rise from left to right."""
    return convolve(frame, n.SOBEL_Y, border)


def sobel_y(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.SOBEL_X, border)


def scharr_x(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.SCHARR_Y, border)


def scharr_y(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.SCHARR_X, border)


def prewitt_x(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.PREWITT_Y, border)


def prewitt_y(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.PREWITT_X, border)


def laplacian(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.LAPLACIAN, border)


def laplacian_8(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.LAPLACIAN_8, border)


def sharpen(frame: ImageFrame, border: Border, pixel: str | PixelType | None = None) -> ImageFrame:
    return convolve(frame, n.SHARPEN, border, pixel or frame.pixel)


def emboss(frame: ImageFrame, border: Border) -> ImageFrame:
    return convolve(frame, n.EMBOSS, border)
