"""What can go wrong, raised while a plan is built wherever the answer does not depend on data."""

from __future__ import annotations


class RasterError(Exception):
    """Base of all errors of this package."""


class PixelTypeError(RasterError, TypeError):
    """An operation that the pixel type does not allow."""


class SizeMismatch(RasterError, ValueError):
    """Two images, or an image and its buffer, differ in size."""


class LengthMismatch(RasterError, ValueError):
    """A buffer's length is not width x height x pixel size."""


class ChannelCountMismatch(RasterError, ValueError):
    """Planes and channels differ in number."""


class TemplateTooLarge(RasterError, ValueError):
    """A template exceeds its image."""


class InvalidBinningStrategy(RasterError, ValueError):
    """Bins that cannot be built."""


class AccumulatorOverflow(RasterError, OverflowError):
    """An integral table's largest possible sum exceeds its accumulator."""


class LabelOverflow(RasterError, OverflowError):
    """More provisional labels than the label type can hold."""


class BorderError(RasterError, ValueError):
    """An operator that needs every pixel of the frame got a border policy that shrinks it."""
