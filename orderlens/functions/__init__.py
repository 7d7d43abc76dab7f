"""Column-to-column functions; all of them run inside the JVM."""

from .scalar import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .vector import *  # noqa: F401,F403
