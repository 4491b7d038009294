"""Readers for logger, weather and irradiance files, and table sinks."""
from .readers import (drop_repeated_headers, first_lines, folder_layouts, latest_file, read_csv, read_csv_any, read_folder_any,  # noqa: F401
                      read_hourly_json, read_hourly_json_any, read_monthly_files, read_preamble_csv, read_preamble_meta, sniff, union_folder)
from .sinks import write_table  # noqa: F401
