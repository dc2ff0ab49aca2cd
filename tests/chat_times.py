"""Instants shared by tests, in a module whose name no other folder uses."""

from datetime import datetime

EPOCH = datetime(2024, 1, 1)
