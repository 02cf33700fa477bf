"""Digests of whole published licences, as their publishers and distributions spell them: (licence, words, first words, digest)."""

PUBLISHED = [
    ("Apache-2.0", 1411, "1 definitions license", "83d450e65487bded604e316138d44bad29b2370fe89c4bea8a4c8bb6427ae8e1"),
    ("Apache-2.0", 1419, "terms and conditions", "d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43"),
    ("Apache-2.0", 1426, "apache license version", "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", 1431, "apache license version", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Apache-2.0", 1602, "apache license version", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Apache-2.0", 1603, "apache license version", "97e95a9b0db10e5b545c5f892eaca80c1a31db38d3c6ad56bc8ef3c066674664"),
    ("Apache-2.0", 1605, "apache license version", "885d8faeae29cb81cc6627c6a6c3aeba7d6182f92e07199b88991c1bada5e0de"),
    ("Artistic-1.0-Perl", 983, "the artistic license", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSL-1.0", 214, "boost software license", "7442addb08927564a6aefb68009afaa4aadf14d9dc8faaae9539cd1b14a7e5e5"),
    ("CC0-1.0", 1088, "creative commons legal", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3315, "gnu free documentation", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", 3732, "gnu free documentation", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("GPL-1.0", 1636, "gnu general public", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-1.0", 1641, "gnu general public", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", 2067, "gnu general public", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", 2027, "terms and conditions", "1b92c2d0044d7adfa5faaa89dd772287319722c8f0179929f0829f55d419e993"),
    ("GPL-2.0", 2467, "preamble the licenses", "a6ea28a0af8184097f47e8f2188793e04fa591d626ddfcea2f4fd249e9e9c7a3"),
    ("GPL-2.0", 2499, "gnu general public", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-2.0", 2504, "gnu general public", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", 2975, "gnu general public", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", 4653, "terms and conditions", "2b9c45ff5a03f2a175be3d88dab38fdd8261f49027843b8fcfdb8ec8a86cdf40"),
    ("GPL-3.0", 5213, "preamble the gnu", "1675579df3e44f1af26f339e3de1593ca52df8b34226c6a165d87641b4e0862f"),
    ("GPL-3.0", 5236, "gnu general public", "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153"),
    ("GPL-3.0", 5241, "gnu general public", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", 5684, "gnu general public", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1"),
    ("LGPL-2.0", 3860, "gnu library general", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.0", 3865, "gnu library general", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", 4200, "gnu library general", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", 4060, "gnu lesser general", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-2.1", 4065, "gnu lesser general", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", 4401, "gnu lesser general", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", 1231, "gnu lesser general", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3789, "mozilla public license", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", 80, "mozilla public license", "c4f374e2647dfb8c880ead23b49e0bd6e8c490d3a2cf9b4ed36426bad15f6e1a"),
    ("MPL-2.0", 2420, "1 definitions 1", "ca15f9cdd3f2fd06a41df42402a3886e1de25f02b077725084c5d8d535cfcec4"),
    ("MPL-2.0", 2426, "mozilla public license", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]
