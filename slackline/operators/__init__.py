"""Operators on DataFrames: timetables, features, journeys, routes, evaluation, models and upkeep."""
