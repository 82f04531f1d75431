"""Where the tables for tests are; a module of its own, as every folder of tests may have a conftest."""

DATA = "/root/testdata"
