"""Print the query names registered by one plans module. Usage: names.py q_metrics"""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import importlib

from wardlake.plans.registry import QUERIES

importlib.import_module(f"wardlake.plans.{sys.argv[1]}")
print(" ".join(QUERIES))
