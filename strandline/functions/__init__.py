"""Column functions over sequences."""

from strandline.functions.scalars import *  # noqa: F403
