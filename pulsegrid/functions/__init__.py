"""Reusable column expressions and skew-safe ordered scans."""
