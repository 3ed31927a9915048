"""All registered queries; importing the modules fills the registry."""

from lodeworks.checks import holes, records, spatial  # noqa: F401
from lodeworks.checks.registry import ORACLES, QUERIES  # noqa: F401
