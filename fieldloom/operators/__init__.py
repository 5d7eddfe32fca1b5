"""Operations by kind. Importing this package registers all of them."""

from . import aggregate, asserts, audit, compare, compose, fields, filters, output, project, rows  # noqa: F401
