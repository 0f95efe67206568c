from pathlib import Path

import pytest

if not Path("/opt/tokenizers/byte_bpe_50k.tiktoken").exists():
    pytest.skip("no vocabulary files", allow_module_level=True)
