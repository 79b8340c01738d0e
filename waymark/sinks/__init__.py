"""Writers."""
from .writers import *  # noqa: F401,F403
