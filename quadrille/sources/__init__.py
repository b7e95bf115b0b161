"""Readers and writers: tileset JSON, packed archives, binary glTF and its codecs."""
