"""The search language: parser, writer, builder and compiler to Catalyst columns."""
