"""Readers with declared schemas."""
from .readers import *  # noqa: F401,F403
