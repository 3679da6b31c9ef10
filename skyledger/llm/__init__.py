"""Operators of a training-data pipeline over the ``documents`` table (and
``pages`` for language identification).  Nothing else in the library imports
this subpackage."""
